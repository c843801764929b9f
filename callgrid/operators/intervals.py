"""Intervals of a call in milliseconds: merging, overlap and clocks that holds pause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from callgrid.operators import scans
from callgrid.session import written


def merge_intervals(df: DataFrame, key: str = "call_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Unions of intervals that overlap or touch: key, start, end. One shuffle on the key."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    grouped = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def merged_array(holds: Column) -> Column:
    """The same for an array of structs (start_ms, end_ms) within one row."""
    pair = lambda s, e: F.struct(s.cast("long").alias("start_ms"), e.cast("long").alias("end_ms"))
    sorted_ = F.array_sort(F.transform(holds, lambda h: pair(h["start_ms"], h["end_ms"])))
    empty = F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")

    def add(acc: Column, h: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(pair(last["start_ms"], F.greatest(last["end_ms"], h["end_ms"]))))
        return F.when((F.size(acc) > 0) & (h["start_ms"] <= last["end_ms"]), joined).otherwise(F.concat(acc, F.array(h)))

    return F.aggregate(sorted_, empty, add)


def overlap(holds: Column, start: Column, end: Column) -> Column:
    """Milliseconds of [start, end] inside holds (merged, as an array)."""
    return F.aggregate(holds, F.lit(0).cast("long"), lambda acc, h: acc + F.greatest(F.lit(0).cast("long"), F.least(end.cast("long"), h["end_ms"]) - F.greatest(start.cast("long"), h["start_ms"])))


def paused_deadline(start: Column, opportunity: Column, holds: Column) -> Column:
    """start + opportunity, moved on by every hold that begins before it; holds merged and in order."""
    state = F.struct((start + opportunity).cast("long").alias("at"), F.lit(False).alias("past"))

    def step(acc: Column, h: Column) -> Column:
        past = acc["past"] | (h["start_ms"] >= acc["at"])
        longer = acc["at"] + h["end_ms"] - F.greatest(h["start_ms"], start.cast("long"))
        return F.struct(F.when(~past & (h["end_ms"] > start), longer).otherwise(acc["at"]).alias("at"), past.alias("past"))

    return F.aggregate(holds, state, step, lambda acc: acc["at"])


def long_merged(df: DataFrame, key: str = "call_id", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """``merge_intervals`` for keys of any length."""
    rows = scans.ranged(df.select(key, start, end), key, start, end)
    flagged = scans.earlier(rows, key, [start, end], {"_reach": (F.max, end)})
    # the ranges stay as they are, so the second scan needs no other order
    flagged = written(flagged.withColumn("_new", F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1)))
    islands = scans.earlier(flagged, key, [start, end], {"_island": (F.sum, "_new")}, own=True)
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def long_deadlines(starts: DataFrame, holds: DataFrame, key: str = "call_id") -> DataFrame:
    """``paused_deadline`` for calls with any number of holds: key, deadline_ms. starts: key (once), start_ms and
    opportunity_ms; holds: key, start_ms, end_ms, in any order. As merged holds lie apart, a hold's begin less
    all held time before it never falls along a call; so the holds that pause the clock are those whose begin,
    so lessened, lies before the unpaused deadline, and no hold waits for the one before."""
    merged = long_merged(holds, key).join(starts.select(key, F.col("start_ms").alias("_start"), (F.col("start_ms") + F.col("opportunity_ms")).alias("_end")), key)
    held = F.greatest(F.lit(0).cast("long"), F.col("end_ms") - F.greatest("start_ms", "_start"))
    rows = scans.earlier(scans.ranged(merged.withColumn("_held", held), key, "start_ms"), key, ["start_ms"], {"_before": (F.sum, "_held")})
    pausing = rows.filter(F.col("start_ms") - F.coalesce("_before", F.lit(0)) < F.col("_end"))
    paused = pausing.groupBy(key).agg(F.sum("_held").alias("_paused"))
    return starts.join(paused, key, "left").select(key, (F.col("start_ms") + F.col("opportunity_ms") + F.coalesce("_paused", F.lit(0))).cast("long").alias("deadline_ms"))


def overlapping(left: DataFrame, right: DataFrame, key: str = "call_id") -> DataFrame:
    """Every pair of a left and a right interval of one key that share time, once: left's columns, right's with
    `right_` before, and overlap_ms. Intervals (start_ms, end_ms; ends excluded) lie in bins of powers of two
    milliseconds: one as long as itself or longer, so in two bins at most, and in coarser ones where the other
    side has longer intervals. Null, empty and turned intervals meet nothing."""
    # the level whose bins are no shorter than the interval
    level = F.ceil(F.log2(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)).cast("double"))).cast("int")
    fine = f"{key} is not null and start_ms < end_ms"
    a, b = left.filter(fine).withColumn("_level", level), right.filter(fine).withColumn("_level", level)
    b = b.select(key, *[F.col(c).alias(f"right_{c}") for c in right.columns if c != key], F.col("_level").alias("_right_level"), "start_ms", "end_ms")
    levels = sorted({r[0] for r in a.select("_level").distinct().unionAll(b.select("_right_level").distinct()).collect()})  # 64 at most
    every = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")

    def binned(df: DataFrame, own: str) -> DataFrame:
        df = df.withColumn("_at", F.explode(F.filter(every, lambda x: x >= F.col(own))))
        width = F.expr("shiftleft(cast(1 as bigint), _at)")
        bins = F.sequence(F.floor(F.col("start_ms") / width), F.floor((F.col("end_ms") - 1) / width))
        return df.withColumn("_bin", F.explode(bins))

    x, y = binned(a, "_level"), binned(b, "_right_level").withColumnsRenamed({"start_ms": "_s", "end_ms": "_e"})
    met = x.join(y, [key, "_at", "_bin"])
    width = F.expr("shiftleft(cast(1 as bigint), _at)")
    once = (F.col("_at") == F.greatest("_level", "_right_level")) & (F.col("_bin") == F.floor(F.greatest("start_ms", "_s") / width))
    shared = F.least("end_ms", "_e") - F.greatest("start_ms", "_s")
    return met.filter(once & (shared > 0)).withColumn("overlap_ms", shared).drop("_at", "_bin", "_level", "_right_level", "_s", "_e")
