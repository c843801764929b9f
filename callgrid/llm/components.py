"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import release, stash


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, in any order). Returns node, label for every node of an edge; the label is the
    smallest node of its component. Each step is a grouped minimum and a join with it."""
    now = stash(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    n = now.count()
    if not n:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stash(small, n)
        release(before)
        if stars(now):
            break
        n = now.count()
    out = stash(now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()), 2 * n)
    release(now)
    return out


def stars(now: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("top")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up > 1 or (up = 1 and top = 1)").count() == 0
