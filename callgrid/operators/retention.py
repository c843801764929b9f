"""A purge of every table at once: what each holds afterwards, counted on the way."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from callgrid.operators import intake


def purge_state(as_of: Column) -> Column:
    """What a purge does with a call: HELD, ALREADY_PURGED, NOT_TOMBSTONED, NOT_DUE (neither asked for nor past its
    retention) or PURGED. Columns: legal_hold, content_purged_at, tombstoned_at, deletion_requested_at,
    retention_expires_at."""
    asked, past = F.col("deletion_requested_at").isNotNull(), F.coalesce(F.col("retention_expires_at") <= as_of, F.lit(False))
    return (
        F.when(F.coalesce("legal_hold", F.lit(False)), "HELD")
        .when(F.col("content_purged_at").isNotNull(), "ALREADY_PURGED")
        .when(F.col("tombstoned_at").isNull(), "NOT_TOMBSTONED")
        .when(~asked & ~past, "NOT_DUE")
        .otherwise("PURGED")
    )


class Purge:
    """The tables after a purge. `tables` has `calls` (rows stay, what tells about people and content is
    overwritten), each of `removed` (rows of purged calls go) and each of `marked` (rows stay, with
    content_purged_at). `kept` tables are only counted. Counts are there once each table has been written or
    read whole; they come from the same pass."""

    def __init__(self, calls: DataFrame, as_of: Column, removed: dict[str, DataFrame], marked: dict[str, DataFrame], kept: dict[str, DataFrame]):
        states = calls.withColumn("_state", purge_state(as_of))
        gone = states.filter("_state = 'PURGED'").select("call_id").distinct()
        self.observed: dict[str, Observation] = {}
        self.tables = {"calls": self._counted("calls", self._overwritten(states, as_of), F.col("_gone")).drop("_gone")}
        for name, rows in removed.items():
            self.tables[name] = self._counted(name, self._flagged(rows, gone), F.col("_gone")).filter("not _gone").drop("_gone")
        for name, rows in marked.items():
            at = F.when(F.col("_gone"), F.coalesce("content_purged_at", as_of)).otherwise(F.col("content_purged_at"))
            self.tables[name] = self._counted(name, self._flagged(rows, gone), F.col("_gone")).withColumn("content_purged_at", at).drop("_gone")
        for name, rows in kept.items():
            self.tables[name] = self._counted(name, self._flagged(rows, gone), F.col("_gone")).drop("_gone")

    def _flagged(self, rows: DataFrame, gone: DataFrame) -> DataFrame:
        return rows.join(gone.withColumn("_gone", F.lit(True)), "call_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))

    def _overwritten(self, states: DataFrame, as_of: Column) -> DataFrame:
        key = F.concat(F.lit("deleted:"), F.col("call_id").cast("string"))
        marks = {"external_ref": key, "idempotency_key": key, "payload_sha256": F.lit(intake.NO_DIGEST), "agent_id": F.lit("[deleted]"), "team_id": F.lit("[deleted]"), "language": F.lit("und"), "call_type": F.lit("unknown"), "processing_state": F.lit("DELETED"), "agent_connected_ms": F.lit(None), "call_complete": F.lit(False), "timing_reliable": F.lit(False), "content_purged_at": as_of}
        rows = states.withColumn("_gone", F.col("_state") == "PURGED").drop("_state")
        return rows.withColumns({c: F.when(F.col("_gone"), m.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, m in marks.items() if c in rows.columns})

    def _counted(self, name: str, rows: DataFrame, gone: Column) -> DataFrame:
        self.observed[name] = Observation(f"purge_{name}")
        return rows.observe(self.observed[name], F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("n_purged"))

    def write(self, path: str, names: Iterable[str] | None = None) -> dict[str, tuple[int, int]]:
        """Writes each table into a folder of its name; gives its rows before, and those of purged calls."""
        for name in names or self.tables:
            self.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        return self.counts(names)

    def counts(self, names: Iterable[str] | None = None) -> dict[str, tuple[int, int]]:
        return {name: (self.observed[name].get["n"], self.observed[name].get["n_purged"]) for name in names or self.tables}
