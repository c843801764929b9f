"""Latest and current rows by revision, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. Filters on the result see only that row: a
    disqualified newest row does not fall back to an older one."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def newest_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def current_audits(calls: DataFrame, audits: DataFrame) -> DataFrame:
    """Calls with their newest audit, where that audit is of the call's own transcript revision. A newest
    audit of an older transcript takes the call out."""
    # only audits of the calls asked for are ranked
    seen = audits.join(calls.select("call_id"), "call_id", "left_semi")
    own = [c for c in audits.columns if c != "call_id"]
    top = seen.groupBy("call_id").agg(F.max_by(F.struct(*own), "revision").alias("_top")).select("call_id", *[F.col(f"_top.{c}").alias("_audited" if c == "transcript_revision" else c) for c in own])
    return calls.join(top, "call_id").filter(F.col("_audited") == F.col("transcript_revision")).drop("_audited")


def latest_reviews(reviews: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """The newest review of each audit; with calls, only of theirs."""
    seen = reviews if calls is None else reviews.join(calls.select("call_id"), "call_id", "left_semi")
    own = [c for c in reviews.columns if c != "audit_id"]
    top = seen.groupBy("audit_id").agg(F.max_by(F.struct(*own), "version").alias("_top"))
    return top.select("audit_id", "_top.*")


def latest_dispositions(calls: DataFrame, dispositions: DataFrame) -> DataFrame:
    """Calls with their newest disposition of the call's own transcript revision; an older transcript's counts for
    nothing, and a call without one is PENDING (status)."""
    own = [c for c in dispositions.columns if c not in ("call_id", "transcript_revision")]
    seen = dispositions.join(calls.select("call_id", "transcript_revision"), ["call_id", "transcript_revision"], "left_semi")
    top = seen.groupBy("call_id").agg(F.max_by(F.struct(*own), "revision").alias("_top")).select("call_id", "_top.*")
    return calls.join(top, "call_id", "left").withColumn("status", F.coalesce("status", F.lit("PENDING")))


def next_revision(existing: DataFrame, batch: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of a batch with the revision numbers that follow those present."""
    base = existing.groupBy(*keys).agg(F.max("revision").alias("_base"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return batch.join(base, keys, "left").withColumn("revision", (F.coalesce("_base", F.lit(0)) + at).cast("int")).drop("_base")
