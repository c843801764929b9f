"""Scans along a key's rows in order, for keys of any length: rows lie in ranges of key and order, a window
runs within each range, and what crosses a range's end comes from a window over the ranges themselves, of
which a key has no more than there are partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from callgrid.session import written

RANGE = "_range"


def ranged(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows with the number of the range that they lie in, written once, so that it stays the same."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, key, *order).withColumn(RANGE, F.spark_partition_id()))


def earlier(rows: DataFrame, key: str, order: list[str], values: dict[str, tuple[Callable[[Column], Column], str]], own: bool = False) -> DataFrame:
    """For each new column: (F.sum, F.max or F.min, column): that over all rows of the key before a row (and
    the row itself with `own`), null where there are none. rows: with their ranges."""
    end = 0 if own else -1
    within = Window.partitionBy(key, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    ranges = rows.groupBy(key, RANGE).agg(*[f(c).alias(f"_of_{new}") for new, (f, c) in values.items()])
    before = Window.partitionBy(key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(key, RANGE, *[f(f"_of_{new}").over(before).alias(f"_by_{new}") for new, (f, _) in values.items()])
    both = rows.withColumns({f"_in_{new}": f(c).over(within) for new, (f, c) in values.items()}).join(ranges, [key, RANGE])
    plus = {new: _joined(f, F.col(f"_in_{new}"), F.col(f"_by_{new}")) for new, (f, _) in values.items()}
    return both.withColumns(plus).drop(*[f"_in_{n}" for n in values], *[f"_by_{n}" for n in values])


def _joined(f: Callable[[Column], Column], a: Column, b: Column) -> Column:
    if f is F.sum:
        return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    return F.greatest(a, b) if f is F.max else F.least(a, b)


def following(rows: DataFrame, key: str, at: str, ahead: int) -> DataFrame:
    """For each distinct key and time, `next`: the key's first time that is `ahead` later or more, or null."""
    times = rows.select(key, at).filter(F.col(at).isNotNull()).distinct()
    marks = times.select(key, F.col(at).alias("_t"), F.col(at).alias("_is"), F.lit(None).cast("long").alias("_of"))
    marks = marks.unionByName(times.select(key, (F.col(at) + ahead).alias("_t"), F.lit(None).cast("long").alias("_is"), F.col(at).alias("_of")))
    dealt = ranged(marks, key, "_t")
    # from the end: a time stands before the question for it
    back = Window.partitionBy(key, RANGE).orderBy(F.desc("_t"), F.desc_nulls_last("_is")).rowsBetween(Window.unboundedPreceding, 0)
    firsts = dealt.groupBy(key, RANGE).agg(F.min("_is").alias("_first"))
    after = Window.partitionBy(key).orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(key, RANGE, F.min("_first").over(after).alias("_later"))
    asked = dealt.withColumn("_near", F.min("_is").over(back)).filter("_of is not null").join(firsts, [key, RANGE])
    # equal times may lie on both sides of a range's end; a later range never holds an earlier time
    return asked.select(key, F.col("_of").alias(at), F.coalesce("_near", "_later").alias("next"))


def kept_apart(rows: DataFrame, key: str, at: str, apart: int) -> DataFrame:
    """Of each key's times, the first, and then the next that is `apart` after the one kept last, by doubling
    pointers: as many rounds as the logarithm of the longest chain."""
    jump = written(following(rows, key, at, apart))
    kept = written(jump.groupBy(key).agg(F.min(at).alias(at)))
    while not jump.filter("next is not null").isEmpty():
        further = kept.join(jump.filter("next is not null"), [key, at]).select(key, F.col("next").alias(at))
        kept = written(kept.unionByName(further))
        there = jump.select(key, F.col(at).alias("next"), F.col("next").alias("_on"))
        jump = written(jump.join(there, [key, "next"], "left").select(key, at, F.col("_on").alias("next")))
    return kept
