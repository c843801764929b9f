"""N-gram Jaccard join by rare-first prefix filtering.

Texts are lower-cased (A-Z), cut into words, and become sets of n-word shingles. Texts with equal sets
form a class; the join runs over classes, by prefix filtering: under any one order of all
shingles, two sets of Jaccard similarity t share one of their first n - ceil(t * n) + 1 shingles.

A first step leaves out texts that have no partner: a part of all shingles, taken by hash, is counted,
and a text with more shingles of its own among them than a partner may lack is similar to nothing. The
sets of the others are counted exactly, shingle by shingle, and ordered rarest first. Classes meet on
prefix shingles of that order. The first shingle that a pair has in common leaves at most n - position
for its overlap, in both sets: that is the positional filter, and the bound itself is the length filter.
The suffix filter (a bound on the overlap from the counts of both sets in parts of the hash space)
precedes the one exact verification of a pair.

Components lose no link although not all pairs are made: small groups of a prefix shingle give all
their pairs; in a large one each member is held against a pivot, verified links are contracted, and
groups inside one component are done. This is repeated with other pivots while it finds links, a few
times; then every pair of different components that passes the filters is verified. A set is sent once
to each task that holds pairs of its hub. Unlike near copies that share rare shingles but are not similar enough still cost a
verification each: no exact join can leave them out.

A text without words, null or empty, has an empty set and no links. A null identifier comes after all
others. Rows that share identifier and text are one document; rows that share an identifier only are
documents of their own, as all rows without an identifier may be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from callgrid.llm.common import _BASE2, NULL_ID, carried, grams, mix, order_id, range_hash, release, signed, slices, stash, text_buffers, text_of, words
from callgrid.llm.components import components

N, PERCENT = 5, 80
PART_BITS, ROUNDS, SMALL = 6, 4, 24
#: A hub's pairs go to tasks of so many.
HUB_PAIRS = 4096
PARTS, BROADCAST_NODES = 1 << PART_BITS, 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(part: pa.RecordBatch, col: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and hashes of the distinct shingles of all texts, sorted by both."""
    off, data = text_buffers(part.column(col))
    data = _LOWER[data]
    starts, ends, first = words(off, data)
    wh = range_hash(data, starts, ends)
    g = grams(wh, n)
    row = np.searchsorted(first, np.arange(len(g)), side="right") - 1
    ok = np.arange(len(g)) + n <= first[row + 1] if len(g) else np.zeros(0, bool)
    count = np.diff(first)
    few = np.flatnonzero((count > 0) & (count < n))
    rows = np.concatenate([row[ok], few])
    hashes = np.concatenate([g[ok], range_hash(wh, first[few], first[few] + count[few], _BASE2)])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def packed(rows: np.ndarray, values: np.ndarray, n_rows: int) -> pa.Array:
    """The 64-bit values of each row as bytes."""
    edges = np.searchsorted(rows, np.arange(n_rows + 1)).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def parts(rows: np.ndarray, h: np.ndarray, n_rows: int) -> pa.Array:
    """For each row, how many of its hashes lie in each part of the hash space."""
    counts = np.bincount(rows * PARTS + (h & np.uint64(PARTS - 1)).astype(np.int64), minlength=n_rows * PARTS)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS * 4), n_rows, [None, pa.py_buffer(counts.astype(np.int32).tobytes())]).cast(pa.binary())


def profiles(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """doc_id, _id, _th, n_shingles, a 128-bit fingerprint of the set (f1, f2) and the packed shingles of
    the part that is counted first: twice the share that a partner may lack."""
    below = np.uint64(min(2**64 - 1, int(2 * (100 - percent) / 100 * 2**64)))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rows, h = shingle_sets(part, "_text", n)
                size = np.bincount(rows, minlength=part.num_rows)
                edge = np.concatenate([[0], np.cumsum(size)])
                with np.errstate(over="ignore"):
                    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (mix(h ^ np.uint64(0xA5A5)), mix(h + np.uint64(0x5DEECE66D)))]
                    f1, f2 = (s[edge[1:]] - s[edge[:-1]] for s in sums)
                some = mix(h ^ np.uint64(0x77)) <= below
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_id"), part.column("_th"), pa.array(size), pa.array(signed(f1)), pa.array(signed(f2)), packed(rows[some], h[some], part.num_rows)], ["doc_id", "_id", "_th", "n_shingles", "f1", "f2", "some"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), order_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_th"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(profile, f"doc_id {kind}, _id long, _th long, n_shingles long, f1 long, f2 long, some binary")


def tokens(rows: DataFrame, col: str) -> DataFrame:
    """token, node, n of packed shingles: a row for each; n is the number in the whole set."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = text_buffers(batch.column(col))
            of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(off) // 8))
            yield pa.RecordBatch.from_arrays([pa.array(data.view(np.int64)), batch.column("node").take(of), batch.column("n").take(of)], ["token", "node", "n"])

    return rows.select("node", "n", col).mapInArrow(each, "token long, node long, n int")


def with_partners(classes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The classes that may have a partner: of the counted part, no more shingles are theirs alone than a
    partner may lack."""
    stand = rows.select(F.col("_row").alias("node"), F.col("n_shingles").cast("int").alias("n"), "some").join(classes.select("node"), "node")
    once = tokens(stand, "some").groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("hi")).filter("node = hi")
    alone = once.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    may_lack = F.col("n_shingles") - F.ceil(F.lit(percent) * F.col("n_shingles") / 100)
    return classes.join(alone, "node", "left").filter(F.coalesce("alone", F.lit(0)) <= may_lack).drop("alone")


def packed_sets(docs: DataFrame, nodes: DataFrame, n_nodes: int, id_col: str, text_col: str, n: int) -> DataFrame:
    """node, n, set (packed shingles, sorted) and parts of nodes: node, _id, _th (the document that stands for it)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                rows, h = shingle_sets(part, "_text", n)
                size = np.bincount(rows, minlength=part.num_rows).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(size), packed(rows, h, part.num_rows), parts(rows, h, part.num_rows)], ["node", "n", "set", "parts"])

    rows = docs.select(order_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_th"), text_of(text_col).alias("_text"))
    rows = rows.join(F.broadcast(nodes) if n_nodes <= BROADCAST_NODES else nodes, ["_id", "_th"]).select("node", "_text")
    return rows.mapInArrow(sets, "node long, n int, set binary, parts binary")


def rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """token, node, n, pos: the prefix of every set under the order of exact counts among the sets. A
    shingle of one set only comes first and meets nothing, so it takes up a place and makes no row."""
    each = tokens(sets, "set")
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    of = Window.partitionBy("node")
    placed = each.join(counts, "token").withColumn("pos", (F.col("n") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("df", "token")) - 1).cast("int"))
    return placed.filter(F.col("pos") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)).select("token", "node", "n", "pos")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, hub: one of the two) whose sets are similar enough, each pair held once
    against the suffix filter and then the bound. A hub's set comes once to each task with its pairs."""

    def blobs(batch: pa.RecordBatch, col: str, kind) -> list[np.ndarray]:
        off, data = text_buffers(batch.column(col))
        return [data[x:y].view(kind) for x, y in zip(off[:-1], off[1:])]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = counts = None
        for batch in batches:
            hubs, others = np.asarray(batch.column("hub")), np.asarray(batch.column("other"))
            keep = []
            for i, (y, c) in enumerate(zip(blobs(batch, "set", np.uint64), blobs(batch, "parts", np.int32))):
                if others[i] == hubs[i]:
                    x, counts = y.copy(), c.astype(np.int64)
                    continue
                least = -(-percent * (len(x) + len(y)) // (100 + percent))
                if len(x) + len(y) - int(np.abs(counts - c).sum()) < 2 * least:
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                if int((x[at] == y).sum()) >= least:
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("hub").take(take), batch.column("other").take(take)], ["a", "b"])

    other = F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    hubs = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("shares"))
    asked = pairs.select("hub", other.alias("other")).join(hubs, "hub").withColumn("share", F.pmod(F.xxhash64("other"), F.col("shares")).cast("int"))
    asked = asked.join(sets.select(F.col("node").alias("other"), "set", "parts"), "other").select("hub", "share", F.lit(1).alias("turn"), "other", "set", "parts")
    own = hubs.join(sets.select(F.col("node").alias("hub"), "set", "parts"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("turn"), F.col("hub").alias("other"), "set", "parts")
    met = own.unionByName(asked).repartition("hub", "share").sortWithinPartitions("hub", "share", "turn")
    return met.select("hub", "other", "set", "parts").mapInArrow(check, "a long, b long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest identifier reachable by links)."""
    rows, heads = headed(docs, id_col, text_col, n, percent)
    of = rows.join(heads, ["f1", "f2"], "left")
    component = F.coalesce("head._id", "_id")
    # a null identifier stays null
    return of.select("doc_id", "n_shingles", F.when(component == NULL_ID, None).otherwise(component).alias("component_id"))


def headed(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The documents' profiles; and f1, f2, head for every class: the document (_id, _th) with the
    smallest identifier, then the smallest text hash, of the class's component."""
    # _row tells rows apart whatever their identifiers; it is made once, as the table is written
    whole = stash(profiles(docs, id_col, text_col, n, percent).withColumn("_row", F.monotonically_increasing_id()))
    n_rows = whole.count()
    rows = stash(whole.drop("some"), n_rows)
    first = F.min(F.struct("_id", "_th", "_row"))
    classes = rows.filter("n_shingles > 0").groupBy("f1", "f2").agg(first.alias("first"), F.first("n_shingles").alias("n_shingles"))
    classes = stash(classes.select("f1", "f2", "n_shingles", F.col("first._row").alias("node"), F.struct("first._id", "first._th").alias("first")), n_rows)
    standing = stash(with_partners(classes, whole, percent).select("node", "first._id", "first._th"), n_rows)
    release(whole)
    sets = stash(packed_sets(docs, standing, standing.count(), id_col, text_col, n))
    groups = stash(rare_first(sets, percent))
    shared = groups.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("token")
    met = stash(groups.join(shared, "token"))
    found = linked(met, sets, percent)

    # only linked classes have a label
    named = classes.join(found, "node")
    heads = named.join(named.groupBy("label").agg(F.min("first").alias("head")), "label").select("node", "head")
    heads = stash(classes.join(heads, "node", "left").select("f1", "f2", F.coalesce("head", "first").alias("head")), n_rows)
    release(classes, standing, sets, groups, met, found)
    return rows, heads


def linked(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, label over all links among the nodes of each token's group (token, node, n, pos)."""
    total = groups.count()
    labels = tested = links = None
    step, more, made = 0, total > 0, []
    while more:
        now = groups.withColumn("label", F.col("node")) if labels is None else groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        # the first pivot is the member with fewest rare shingles, then any
        order = F.struct(F.when(F.lit(step == 0), F.col("pos")).otherwise(0).alias("p"), F.xxhash64(F.lit(step), "node").alias("h"))
        alike = now.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"), F.min_by(F.struct(F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la")), order).alias("pivot"), F.min(order).alias("o"))
        # top: the label that most of a group have; every pair of different labels has a member outside it
        whole = [F.sum("k").alias("c"), F.sum(F.expr("cast(k as double) * k")).alias("kk"), F.max_by("label", F.struct("k", "label")).alias("top"), F.max("k").alias("most"), F.min_by("pivot", "o").alias("pivot")]
        open_ = stash(alike.groupBy("token").agg(*whole).filter("most < c"), total)
        pairs_left = open_.agg(F.sum(F.expr("(cast(c as double) * c - kk) / 2"))).first()[0]
        if not pairs_left:
            break
        # small groups give all their pairs at once, large ones those with a pivot
        last = step >= ROUNDS or pairs_left <= total
        small = F.lit(True) if last else F.col("c") <= SMALL
        member = now.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"))
        outside = now.join(open_.filter(small).select("token", "top"), "token").filter("label <> top").select("token", "top", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"))
        least = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
        fits = (F.col("la") != F.col("lb")) & (F.col("na") - F.col("pa") >= least) & (F.col("nb") - F.col("pb") >= least)
        pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("hub")]
        large = open_.filter(~small).select("token", "pivot.*")
        pairs = outside.join(member, "token").filter("lb = top or a < b").filter(fits).select(pair).unionByName(member.join(large, "token").filter(fits).select(pair))
        pairs = pairs.groupBy("a", "b").agg(F.min("hub").alias("hub"))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stash(pairs)
        tested = pairs.select("a", "b") if tested is None else tested.unionByName(pairs.select("a", "b"))
        got = stash(verified(pairs, sets, percent))
        links = got if links is None else links.unionByName(got)
        found = not got.isEmpty()
        made += [open_, pairs, got]
        if found or labels is None:
            release(labels)
            labels = components(links)
        if last:
            break
        groups = stash(groups.join(large.select("token"), "token", "left_semi"), total)
        made.append(groups)
        step, more = step + 1 if found else ROUNDS, not groups.isEmpty()
    if labels is not None:
        release(*made)
    return labels if labels is not None else groups.select("node", F.col("node").alias("label")).limit(0)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns as they are, with the smallest identifier of their component; of
    several such documents one stays. Those without words all stay."""
    rows, heads = headed(docs, id_col, text_col, n, percent)
    first = heads.select("head._id", "head._th").unionByName(rows.filter("n_shingles = 0").select("_id", "_th")).distinct()
    rows = docs.select(carried(docs.columns).alias("_row"), order_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_th"))
    return rows.join(first, ["_id", "_th"], "left_semi").select("_row.*")
