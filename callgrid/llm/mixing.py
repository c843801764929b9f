"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source fall into blocks by a seeded hash. The mix of a source is a number of whole
passes over its blocks and a part of one more, in which blocks come in a seeded order of their own until
the target is met; so each source has an exact quota of block draws. A binary tree over the output
shards splits all quotas at once: each node draws from the multivariate hypergeometric law how many
draws of each source go left. Every shard walks its own path from the root (node draws are seeded by the
node, so all shards agree), and ends with a count and an offset for each source: disjoint runs of that
source's permuted blocks. A document is in the mix as often as a shard has drawn its block; nothing else
puts it there. Rows go to the shards that drew them and are shuffled there.

In the block at which a source's target is met, documents are taken while they bring it nearer, and at
most one document of the pass is then added to that block or left out, the one that mends the rest best.

Null sources form one source after all others. Null and empty texts have size 0; they are drawn with
their blocks. Rows alike in all columns are interchangeable; rows that differ anywhere are rows of their
own. Sources and their targets are a table; only the tree has a column for each of at most TREE_COLUMNS
sources, beyond which several sources lie end to end in one column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import carried, mix as spread, quoted, stash, text_of
from callgrid.llm.running import running_totals

WORD = r"[^\x20\x09-\x0D]+"
TREE_COLUMNS, BROADCAST_SOURCES = 100_000, 100_000
#: Blocks of a shard at the least, and documents of a block, both on average.
SHARD_BLOCKS, BLOCK_DOCS = 64, 1024


def n_words(col: str) -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def cycle_weights(rank: Column) -> Column:
    """1, 2, 3, 1, 2, 3, ... of sources in the order of their code points, null last; rank begins at 0."""
    return (rank % 3 + 1).cast("double")


def row_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[Column, Column]:
    """Two hashes of a whole row: rows with the same keys are alike in all columns."""
    rest = carried([c for c in docs.columns if c not in (id_col, text_col, source_col)], ())
    own = [F.col(id_col), F.col(text_col), F.col(source_col)]
    if len(docs.columns) > 3:
        own.append(F.to_json(rest))
    return F.xxhash64(F.lit(seed), *own), F.xxhash64(F.lit(seed + 1), *own[::-1])


def permuted(at: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each place at in [0, n), its place in a permutation of [0, n) that the key names: four
    rounds of a keyed exchange of halves, repeated until the outcome is below n."""
    at, n, key = at.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(np.float64)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = at.copy(), np.arange(len(at))
    while len(open_):
        left, right, k, m = out[open_] >> half[open_], out[open_] & mask[open_], key[open_], mask[open_]
        with np.errstate(over="ignore"):
            for r in range(4):
                left, right = right, left ^ (spread(right * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r)) & m)
        out[open_] = (left << half[open_]) | right
        open_ = open_[out[open_] >= n[open_]]
    return out.astype(np.int64)


def shard_runs(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and offsets of one shard's draws, for every column: its path from the tree's root."""
    counts, offsets = quotas.astype(np.int64).copy(), np.zeros(len(quotas), np.int64)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(counts.sum())
        take = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(counts, take, method="marginals") if total else np.zeros_like(counts)
        if shard < mid:
            counts, hi = left, mid
        else:
            counts, offsets, lo = counts - left, offsets + left, mid
    return counts, offsets


def draws(spark, quotas: np.ndarray, shards: int, seed: int) -> DataFrame:
    """bin, position, shard: who draws each position of each column's line. Every shard walks the tree by itself."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                counts, offsets = shard_runs(quotas, shards, shard, seed)
                for some in np.array_split(np.flatnonzero(counts), max(1, int(counts.sum()) >> 16)):
                    n = counts[some]
                    at = np.arange(int(n.sum())) + np.repeat(offsets[some] - (np.cumsum(n) - n), n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, n)), pa.array(at), pa.array(np.full(len(at), shard, np.int64))], ["bin", "position", "shard"])

    return spark.range(shards).mapInArrow(walk, "bin long, position long, shard long")


def targets(sources: DataFrame, weights, total_share: float, most: float) -> DataFrame:
    """sources: _source, size, n. Adds _sid (place by code point, null last) and _target: in proportion
    to the weights, none above `most` times its size; the excess is shared again by weight among the
    others until none is above. With sources by the level at which they are full, that is one level for all others."""
    one = sources.withColumns({"_all": F.lit(0), "_null": F.col("_source").isNull(), "_one": F.lit(1).cast("long")})
    ranked = running_totals(one, "_all", ["_null", "_source"], {"_sid": "_one"})
    ranked = ranked.withColumns({"_cap": most * F.col("size"), "_weight": weights(F.col("_sid"))})
    ranked = ranked.withColumn("_full_at", F.coalesce(F.try_divide("_cap", "_weight"), F.lit(float("inf"))))
    sums = running_totals(ranked, "_all", ["_full_at", "_sid"], {"_caps": "_cap", "_weights": "_weight"})
    total, weight = ranked.agg(F.coalesce(F.sum("size"), F.lit(0)) * total_share, F.sum("_weight")).first()
    level = F.try_divide(F.lit(float(total)) - F.col("_caps"), F.lit(float(weight or 0)) - F.col("_weights"))
    first = sums.withColumn("_level", level).filter(F.col("_level") <= F.col("_full_at")).agg(F.min_by("_level", F.struct("_full_at", "_sid"))).first()[0]
    target = F.col("_cap") if first is None else F.least(F.lit(float(first)) * F.col("_weight"), F.col("_cap"))
    return sums.select("_source", "_sid", "size", "n", F.coalesce(target, F.lit(0.0)).alias("_target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=cycle_weights, total_share: float = 1.0, max_repeats: float = 3.0, words_per_shard: int = 2_000_000, seed: int = 17, tree_columns: int = TREE_COLUMNS) -> DataFrame:
    """One row a document: doc_id, _h and _k (its keys), _size, _source_size, _target and _places, an
    array of (shard, order) with an entry for each draw of the document. Texts are not carried along."""
    spark = docs.sparkSession
    h, k = row_keys(docs, id_col, text_col, source_col, seed)
    lined = stash(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("_source"), n_words(text_col).alias("_size"), h.alias("_h"), k.alias("_k")).withColumn("_row", F.monotonically_increasing_id()))
    sources = stash(targets(stash(lined.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n"))), weights, total_share, max_repeats))
    n_sources, words = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("_target"), F.lit(0.0))).first()

    def each(table: DataFrame) -> DataFrame:
        """A table with a row for each source: broadcast up to a number of sources."""
        return F.broadcast(table) if n_sources <= BROADCAST_SOURCES else table

    shards = max(1, -(-int(words) // words_per_shard))
    blocks = F.greatest(F.lit(1), F.least(F.col("n"), F.greatest(F.ceil(F.col("size") * SHARD_BLOCKS / words_per_shard), F.ceil(F.col("n") / BLOCK_DOCS)))).cast("long")
    passes = F.when(F.col("size") > 0, F.floor(F.col("_target") / F.greatest("size", F.lit(1)))).otherwise(0).cast("long")
    sources = sources.withColumns({"_blocks": blocks, "_passes": passes}).withColumn("_rest", F.when(F.col("size") > 0, F.col("_target") - F.col("_passes") * F.col("size")).otherwise(0.0))
    named = sources.withColumnsRenamed({"_source": "_ss", "size": "_source_size"}).drop("n")
    joined = lined.join(each(named), F.col("_source").eqNullSafe(F.col("_ss"))).drop("_ss", "_source")
    joined = joined.withColumn("_block", F.least(F.floor(F.shiftrightunsigned("_h", 11).cast("double") / 2**53 * F.col("_blocks")), F.col("_blocks") - 1).cast("long"))

    def places(part: pa.RecordBatch, at_pass: np.ndarray) -> np.ndarray:
        """Where a document's block stands in the order of a pass."""
        own = {c: np.asarray(part.column(c)) for c in ("_block", "_blocks", "_sid")}
        with np.errstate(over="ignore"):
            key = spread(own["_sid"].astype(np.uint64) * np.uint64(1_000_003) + at_pass.astype(np.uint64)) + np.uint64(seed)
        return permuted(own["_block"], own["_blocks"], key)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("_turn", pa.array(places(batch, np.asarray(batch.column("_passes")))))

    last = joined.mapInArrow(turn, joined.select("*", F.lit(0).cast("long").alias("_turn")).schema)
    summed = running_totals(last, "_sid", ["_turn", "_h", "_k", "_row"], {"_before": "_size"})
    took = (F.col("_rest") > 0) & (F.col("_before") + F.col("_size") / 2 < F.col("_rest"))
    summed = summed.withColumn("_more", took)
    # where the last document misses the target, the one document is added or left out that mends it best
    missed = summed.groupBy("_sid").agg((F.max("_rest") - F.sum(F.when(F.col("_more"), F.col("_size")).otherwise(0))).alias("_miss"), F.max(F.when(F.col("_more"), F.col("_turn"))).alias("_ends"))
    gain = F.abs("_miss") - F.abs(F.abs(F.col("_miss")) - F.col("_size"))
    mend = summed.join(each(missed), "_sid").filter((F.col("_more") == (F.col("_miss") < 0)) & (F.col("_rest") > 0) & (gain > 0)).groupBy("_sid").agg(F.max(F.struct(gain.alias("gain"), F.col("_h").alias("h"), F.col("_row").alias("row")))["row"].alias("_mend"))
    fixed = summed.join(each(missed.select("_sid", "_ends")), "_sid").join(each(mend), "_sid", "left")
    mended = F.coalesce(F.col("_row") == F.col("_mend"), F.lit(False))
    fixed = fixed.withColumns({"_turn": F.when(mended & ~F.col("_more"), F.coalesce("_ends", F.lit(0))).otherwise(F.col("_turn")), "_more": F.col("_more") != mended})
    fixed = stash(fixed.select("_row", "doc_id", "_h", "_k", "_size", "_sid", "_block", "_blocks", "_passes", "_turn", "_more", "_source_size", "_target"))

    # the quota of a source: its whole passes, and the turns of the last one up to where its target is met
    quota = fixed.groupBy("_sid").agg((F.max("_passes") * F.max("_blocks") + F.coalesce(F.max(F.when(F.col("_more"), F.col("_turn") + 1)), F.lit(0))).alias("_quota"))
    quota = stash(running_totals(quota.withColumn("_bin", F.col("_sid") % tree_columns), "_bin", ["_sid"], {"_offset": "_quota"}))
    by_bin = {r["_bin"]: r["q"] for r in quota.groupBy("_bin").agg(F.sum("_quota").alias("q")).collect()}  # at most tree_columns rows
    quotas = np.array([by_bin[b] for b in sorted(by_bin)], dtype=np.int64)
    shards = max(1, min(int(quotas.sum()), shards))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks_, passes_, offset = (np.asarray(batch.column(c)) for c in ("_blocks", "_passes", "_offset"))
            for p in range(int(passes_.max(initial=0)) + 1):
                whole = p < passes_
                at = np.where(whole, places(batch, np.full(batch.num_rows, p)), np.asarray(batch.column("_turn")))
                some = np.flatnonzero(whole | ((p == passes_) & np.asarray(batch.column("_more"))))
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays([batch.column("_row").take(take), batch.column("_h").take(take), batch.column("_bin").take(take), pa.array((offset + p * blocks_ + at)[some])], ["_row", "_h", "bin", "position"])

    asked = fixed.join(each(quota.select("_sid", "_bin", "_offset")), "_sid")
    drawn = asked.mapInArrow(positions, "_row long, _h long, bin long, position long").join(draws(spark, quotas, shards, seed), ["bin", "position"])
    drawn = drawn.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("shard", F.xxhash64(F.lit(seed), "position", "_h").alias("order")))).alias("_places"))
    empty = F.expr("array()").cast(drawn.schema["_places"].dataType)
    return fixed.join(drawn, "_row", "left").select("doc_id", "_h", "_k", "_size", "_source_size", "_target", F.coalesce("_places", empty).alias("_places"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mix itself: a row of `docs` each time it is drawn, dealt to its shard and in that shard's order."""
    plan = plan_mix(docs, id_col, text_col, source_col, seed=seed, **options)
    places = plan.select("_h", "_k", F.explode("_places").alias("_place"))
    h, k = row_keys(docs, id_col, text_col, source_col, seed)
    # rows alike in all columns are one row here, with the places of all
    rows = docs.select(F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("_row"), h.alias("_h"), k.alias("_k")).dropDuplicates(["_h", "_k"])
    drawn = rows.join(places, ["_h", "_k"]).select("_row", "_place")
    return drawn.repartition("_place.shard").sortWithinPartitions("_place.shard", "_place.order").select("_row.*")
