"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by random projections, each cut into cells of width w: floor((a.x + b) / w). The
number of functions grows with the logarithm of the rows, so that a bucket holds about `bucket_rows` of
them at any size. A neighbour's projection lies normally around the query's; how far it is drawn to the
mean, and its spread, come from sample vectors and their neighbours, scaled by the query's own distance
to them. The product over the functions is the estimated success of a bucket. A query visits the home
bucket and perturbed ones in order of that estimate, found without listing the buckets there are, until
the estimates add up to `mass` or `most_probes` are taken. What it meets there is compared exactly, and
the k-th distance bounds its search.

The estimates promise nothing on other rows, so an exact check follows: the buckets of the first table lie
in packs, side by side, and the packs are dealt out in shares. Blocks of queries go to every share with
their bounds, and a query is compared with the rows of each bucket whose centre and radius do not place it
beyond the bound. The result is that of brute force on any rows. Where squares would leave the range of
doubles, powers of two are taken out first, so that components may have any finite size; distances beyond
the largest double are infinite, and ties. Where vectors have structure, most buckets are left out; of
vectors without (64 independent components), the 10 nearest are hardly nearer than the rest, and all are
compared. Work is then queries times rows, while a task holds one pack and one block at a time.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an
identifier. Vectors meet only vectors of their own length. Of equal vectors only the k + 1 smallest
identifiers can be results, and only those are indexed. Rows that share an identifier are one candidate
for a query, at its smallest distance. Hot buckets are cut into chunks of bounded size.

Means, spreads and neighbour distances come from a sample of `sample` vectors (smallest hashes of the
identifier); every vector is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from callgrid.llm.common import mix, n_parts, release, signed, stash

CHUNK_VALUES, BLOCK_VALUES, VISIT_VALUES, QUERY_BATCH, SHARE_ROWS, SALTS, MOST_PROBES, PROBES = 1 << 18, 1 << 16, 1 << 21, 256, 200_000, 64, 1 << 17, 32
HELD, SHRINK = 200_000, 1 << 19  # rows that a task holds before they are sent on, and before they are cut to k of a query
LEAST, FARTHEST, CELLS = 1e-290, 1e100, 1 << 62  # squares below this have lost digits; hashing takes larger components and cells as these


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col(vec_col)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    # single precision stays as it is stored until it is compared
    own = vec if rows.schema[vec_col].dataType.simpleString() == "array<float>" else vec.cast("array<double>")
    return rows.filter(F.col(id_col).isNotNull() & vec.isNotNull()).filter(fine).select(F.col(id_col).cast("long").alias("id"), own.alias("v"), F.size(vec).alias("dim"))


def level(*arrays: np.ndarray) -> int:
    """The power of two that brings the largest component to between 0.5 and 1."""
    return int(np.frexp(max(np.abs(a).max(initial=0) for a in arrays))[1])


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, also where the squares leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore"):
        d2 = ((y - x) ** 2).sum(axis=1)
        d = np.sqrt(d2)
        odd = np.flatnonzero(~((d2 > LEAST) & (d2 < np.inf)))
        if len(odd):
            # a difference that overflows is taken of the halves
            gap = y[odd] - x[odd]
            wide = ~np.isfinite(gap).all(axis=1)
            gap[wide] = y[odd[wide]] / 2 - x[odd[wide]] / 2
            at = np.frexp(np.abs(gap).max(axis=1, initial=0))[1]
            d[odd] = np.ldexp(np.sqrt((np.ldexp(gap, -at[:, None]) ** 2).sum(axis=1)), at + wide)
    return d


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


_erf = np.vectorize(math.erf, otypes=[float])


class Geometry:
    """Projections, cells and estimated success for vectors of one length."""

    def __init__(self, dim: int, sample: np.ndarray, near: int, tables: int, functions: int, width: float, seed: int, most_probes: int = MOST_PROBES):
        rng = np.random.default_rng([seed, dim])
        self.a = rng.standard_normal((tables, dim, functions))
        self.level = level(sample)
        sample = self.scaled(sample)
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(dim)
        self.sample, self.near, self.most_probes = sample, near, most_probes
        placed = (sample - self.mean) @ self.a
        spread = placed.std(axis=1) if len(sample) > 1 else np.ones((tables, functions))
        self.width = np.maximum(width * spread, 1e-12)
        offset = rng.uniform(0, 1, (tables, functions))
        # how a neighbour's projection follows a vector's: slope and spread
        self.slope, self.spread, self.usual = 1.0, 1.0, 1.0
        if len(sample) > 2:
            some = sample[: min(256, len(sample))]
            d2 = squares(some, sample)
            at = np.argsort(d2, axis=1)[:, min(near, len(sample) - 1)]
            x, y = placed[:, : len(some)].reshape(-1), placed[:, at].reshape(-1)
            self.slope = float((x * y).sum() / max((x * x).sum(), 1e-12))
            self.usual = float(np.sqrt(np.maximum(d2[np.arange(len(some)), at], 1e-12)).mean())
            self.spread = max(float((y - self.slope * x).std()), 1e-9)
        # cells narrower than a neighbour's spread would only be more buckets to visit
        self.width = np.maximum(self.width, self.spread if len(sample) > 2 else 1e-12)
        self.shift = offset * self.width

    def scaled(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", under="ignore"):
            return np.clip(np.ldexp(x, -self.level), -FARTHEST, FARTHEST)

    def reach(self, x: np.ndarray) -> np.ndarray:
        """Each query's estimated distance of a k-th neighbour: that of its `near`-th sample vector."""
        if not len(self.sample):
            return np.ones(len(x))
        at = min(self.near, len(self.sample)) - 1
        return np.sqrt(np.maximum(np.partition(squares(self.scaled(x), self.sample), at, axis=1)[:, at], 1e-12))

    def place(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) - self.mean) @ self.a  # tables, rows, functions

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of every vector in every table."""
        return named(np.clip(np.floor((self.place(x) + self.shift[:, None]) / self.width[:, None]), -CELLS, CELLS).astype(np.int64))

    def probes(self, x: np.ndarray, table: int, mass: float) -> Iterator[np.ndarray]:
        """For each query its buckets in order of estimated success, up to the mass or the likeliest most_probes."""
        at = self.place(x)[table]
        centre, spread = self.slope * at, self.spread * self.reach(x)[:, None] / self.usual * np.ones(at.shape)
        for q in range(len(x)):
            best, odds, cells = 0.0, [], []
            for j in range(at.shape[1]):
                w, c, s = self.width[table, j], centre[q, j] + self.shift[table, j], spread[q, j]
                # of one function, the likeliest most_probes cells lie within so many of the centre's
                home = max(-CELLS, min(CELLS, math.floor(c / w)))
                cell = np.arange(max(home - self.most_probes, math.floor((c - 4 * s) / w)), min(home + self.most_probes, math.floor((c + 4 * s) / w)) + 1)
                edge = 0.5 * (1 + _erf((np.append(cell, cell[-1] + 1) * w - c) / (s * math.sqrt(2))))
                p = np.diff(edge)
                order = np.argsort(-p, kind="stable")[: max(1, int((p > 1e-9).sum()))]
                log = np.log(np.maximum(p[order], 1e-300))
                best += log[0]
                odds.append(log[0] - log)
                cells.append(cell[order])
            # perturbation sets by what they cost against the likeliest bucket: parts of the m cheapest are
            # among the m cheapest parts; m is raised until they hold the mass
            m = min(64, self.most_probes)
            while True:
                cost, picks = np.zeros(1), np.zeros((1, 0), np.int64)
                for odd, cell in zip(odds, cells):
                    sums = (cost[:, None] + odd[None]).reshape(-1)
                    keep = np.argpartition(sums, m - 1)[:m] if len(sums) > m else np.arange(len(sums))
                    cost, picks = sums[keep], np.column_stack([picks[keep // len(odd)], cell[keep % len(odd)]])
                success = np.exp(best - cost)
                if success.sum() >= mass or len(cost) < m or m == self.most_probes:
                    break
                m = min(8 * m, self.most_probes)
            order = np.argsort(cost, kind="stable")
            taken = np.searchsorted(np.cumsum(success[order]), mass) + 1
            yield np.unique(named(picks[order[:taken]]))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T


def named(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of all functions (the last axis); a collision only adds candidates."""
    h = np.zeros(cells.shape[:-1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(cells.shape[-1]):
            h = mix((h ^ cells[..., j].astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    return signed(h)


def tame(vs: np.ndarray, qs: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Rows, queries and bounds less a power of two, if squares of the largest could leave the range of
    doubles; what is lost of the smallest lies far below LEAST. And the square beyond which distances may
    be infinite as doubles."""
    at = level(vs, qs)
    if abs(at) < 300:
        return vs, qs, bound, np.inf
    return np.ldexp(vs, -at), np.ldexp(qs, -at), np.ldexp(bound, -at), np.ldexp(np.finfo(float).max, -at) ** 2 * (1 - 1e-9)


def closest(ids: np.ndarray, vs: np.ndarray, qids: np.ndarray, qs: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and distance of pairs of different identifiers: for each query the k nearest identifiers
    with all ties, as far as they lie within its bound, and some more. A product of matrices finds the pairs,
    with an allowance for its rounding; their distance is taken from the vectors themselves."""
    eps = 4 * np.finfo(float).eps * (vs.shape[1] + 8)
    with np.errstate(over="ignore", under="ignore"):
        v, x, bound, far = tame(vs, qs, bound)
        middle = v.mean(axis=0)
        v, x = v - middle, x - middle
        size = (x**2).sum(axis=1)[:, None], (v**2).sum(axis=1)[None]
        low = x @ v.T
        low *= -2
        low += (1 - eps) * size[0]
        low += (1 - eps) * size[1]
        most = bound**2 * (1 + eps) + LEAST
        fits = ~(low > most[:, None])
        many = np.flatnonzero(fits.sum(axis=1) > 4 * (k + 1))
        if len(many):  # the limit is that of the k-th identifier beside the query's own
            high = low[many] + 2 * eps * (size[0][many] + size[1]) + LEAST
            order = np.argsort(ids, kind="stable")
            head = np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1]))
            if len(head) < len(ids):
                high = np.minimum.reduceat(high[:, order], head, axis=1)
            if high.shape[1] > k + 1:
                limit = np.partition(high, k, axis=1)[:, k]
                limit[limit > far] = np.inf
                fits[many] &= ~(low[many] > limit[:, None])
        i, j = np.nonzero(fits)
        other = qids[i] != ids[j]
        i, j = i[other], j[other]
        step = max(1, VISIT_VALUES // vs.shape[1])
        d = np.concatenate([apart(qs[i[at : at + step]], vs[j[at : at + step]]) for at in range(0, max(1, len(i)), step)])
    return qids[i], ids[j], d


def within(vs: np.ndarray, sizes: np.ndarray, qs: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which runs of rows (buckets of these sizes, side by side) may hold a row within each query's bound."""
    head = np.append(0, np.cumsum(sizes)[:-1])
    with np.errstate(over="ignore", under="ignore"):
        v, x, bound, _ = tame(vs, qs, bound)
        middle = v.mean(axis=0)
        v, x = v - middle, x - middle
        centre = np.add.reduceat(v, head, axis=0) / sizes[:, None]
        radius = np.sqrt(np.maximum.reduceat(((v - np.repeat(centre, sizes, axis=0)) ** 2).sum(axis=1), head))
        size = (x**2).sum(axis=1)[:, None] + (centre**2).sum(axis=1)[None]
        low = np.sqrt(np.maximum(size * (1 - 1e-9) - 2 * x @ centre.T, 0))
        return ~(low > (radius[None] + bound[:, None]) * (1 + 1e-9) + math.sqrt(LEAST))


def cut(found: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest identifiers of each query, each at its smallest distance, ties to the smaller one."""
    q, i, d = found
    order = np.lexsort((d, i, q))
    q, i, d = q[order], i[order], d[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (i[1:] != i[:-1])
    q, i, d = q[new], i[new], d[new]
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], i[top], d[top]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 2, width: float = 2.0, bucket_rows: int = 64, mass: float = 0.72, sample: int = 2048, seed: int = 11, most_probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query, its own row left out."""
    base, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    some = base.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    total = max(1, base.count())
    # the k-th of all rows is about this one of the sample; the query itself and two more for caution
    near = math.ceil(k * min(sample, total) / total) + 3
    # a function with cells of this width tells 2 ** bits cells apart
    bits = max(0.1, math.log2(math.sqrt(2 * math.pi * math.e) / width))
    functions = max(1, round(math.log2(max(2, total / bucket_rows)) / bits))
    kind = base.schema["v"].dataType.simpleString()
    geometry: dict[int, Geometry] = {}

    def of(dim: int) -> Geometry:
        if dim not in geometry:
            own = some[some["dim"] == dim]["v"]
            x = np.array(own.tolist(), dtype=np.float64).reshape(len(own), dim)
            geometry[dim] = Geometry(dim, x, near, tables, functions, width, seed, most_probes)
        return geometry[dim]

    def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
        dims = np.asarray(batch.column("dim"))
        for dim in np.unique(dims):
            yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_dim(batch):
                codes = of(dim).buckets(matrix(part.column("v"), dim))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(np.full(part.num_rows, t, np.int32)), pa.array(codes[t]), part.column("id"), part.column("v")], ["dim", "t", "bucket", "id", "v"])

    # repeated rows go first: copies are counted over identifiers, and of a common vector in shares first
    kept = base.dropDuplicates(["id", "v"]).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for by in (["v", "_salt"], ["v"]):
        kept = kept.withColumn("_copy", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("_copy") <= k + 1).drop("_copy")
    index = stash(kept.drop("_salt").mapInArrow(hashed, f"dim int, t int, bucket long, id long, v {kind}"))
    sizes = index.groupBy("dim", "t", "bucket").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("dim") / CHUNK_VALUES))
    packed = stash(
        index.join(sizes, ["dim", "t", "bucket"])
        .groupBy("dim", "t", "bucket", F.pmod(F.xxhash64("id"), chunks).alias("chunk"))
        .agg(F.collect_list(F.struct("id", "v")).alias("rows"))
        .select("dim", "t", "bucket", "chunk", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("vs"))
    )
    release(index)
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some_ in by_dim(batch):
                step = max(1, min(QUERY_BATCH, VISIT_VALUES // (dim * most_probes)))
                for lo in range(0, some_.num_rows, step):
                    part = some_.slice(lo, step)
                    x = matrix(part.column("v"), dim)
                    for t in range(tables):
                        visits = list(of(dim).probes(x, t, mass))
                        q, b = np.repeat(np.arange(len(visits)), [len(v) for v in visits]), np.concatenate(visits)
                        order = np.argsort(b, kind="stable")
                        yield asking(part, dim, t, b[order], q[order])

    def asking(part: pa.RecordBatch, dim: int, t: int, b: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket (in order) with the numbers and vectors of the queries that visit it."""
        head = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        edge = pa.array(np.append(head, len(b)).astype(np.int32))
        take = part.take(pa.array(q))
        at = pa.array((np.append(head, len(b)) * dim).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(head), dim, np.int32)), pa.array(np.full(len(head), t, np.int32)), pa.array(b[head]), pa.ListArray.from_arrays(edge, take.column("id")), pa.ListArray.from_arrays(at, take.column("v").flatten())], ["dim", "t", "bucket", "qids", "qs"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return cut(tuple(map(np.concatenate, zip(*held))), k)

        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                ids, qids, sizes, bounds = (np.asarray(batch.column(c)[r].values) for c in ("ids", "qids", "sizes", "bounds"))
                vs, qs = (np.asarray(batch.column(c)[r].values, dtype=np.float64).reshape(-1, dim) for c in ("vs", "qs"))
                step = max(1, min(2 * QUERY_BATCH, VISIT_VALUES // len(ids)))
                for lo in range(0, len(qids), step):
                    q, x, bound = (a[lo : lo + step] for a in (qids, qs, bounds))
                    may = within(vs, sizes, x, bound) if len(sizes) > 1 else np.ones((len(q), 1), bool)
                    if may.mean() > 0.5:
                        runs = [(slice(None), slice(None))]
                    else:
                        end = np.cumsum(sizes)
                        runs = [(np.flatnonzero(may[:, b]), slice(end[b] - sizes[b], end[b])) for b in np.flatnonzero(may.any(axis=0))]
                    for some_q, some_v in runs:
                        held.append(closest(ids[some_v], vs[some_v], q[some_q], x[some_q], bound[some_q], k))
                        n += len(held[-1][0])
                    if n > SHRINK or len(held) > SHRINK // 16:
                        held = [merged()]
                        n = len(held[0][0])
                    if n > HELD:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, merged())], ["query_id", "vec_id", "score"])
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, merged())], ["query_id", "vec_id", "score"])

    met = "query_id long, vec_id long, score double"
    top = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        own = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return own.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)

    # both joins are merges: Spark's estimate knows nothing of a query's copies for its buckets and for the
    # shares, and would send all of them through the driver as a broadcast
    # the likeliest buckets give each query a distance that its k-th neighbour is not beyond
    visits = asked.mapInArrow(probes, f"dim int, t int, bucket long, qids array<long>, qs {kind}").join(packed.hint("merge"), ["dim", "t", "bucket"])
    free = F.array_repeat(F.lit(float("inf")), F.size("qids"))
    first = visits.select("dim", "ids", "vs", F.array(F.size("ids")).alias("sizes"), "qids", "qs", free.alias("bounds")).mapInArrow(rerank, met)
    bounds = stash(ranked(first).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound")))
    # and all buckets that may hold a nearer row are gone through
    n_packs = F.ceil(F.lit(total) * F.col("dim") / CHUNK_VALUES)
    n_asked = max(1, asked.count())
    # copies of queries are no more than rows, as long as a share holds few enough rows for a task
    shares = F.least(F.lit(max(min(n_parts(vectors), total // n_asked), SALTS, math.ceil(total / SHARE_ROWS))), n_packs)
    pack = F.pmod(F.xxhash64("bucket", "chunk"), n_packs)
    packs = packed.filter("t = 0").groupBy("dim", pack.alias("pack")).agg(F.collect_list(F.struct("ids", "vs")).alias("runs"))
    rows = packs.select("dim", F.pmod("pack", shares).alias("share"), F.flatten("runs.ids").alias("ids"), F.flatten("runs.vs").alias("vs"), F.transform("runs.ids", F.size).alias("sizes"))
    block = F.pmod(F.xxhash64("id"), F.ceil(F.lit(n_asked) * F.col("dim") / BLOCK_VALUES))
    bounded = asked.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    blocks = bounded.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("id", "v", "bound")).alias("q"))
    everywhere = blocks.select("dim", F.col("q.id").alias("qids"), F.flatten("q.v").alias("qs"), F.col("q.bound").alias("bounds"), F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"))
    pairs = everywhere.join(rows.hint("merge"), ["dim", "share"]).select("dim", "ids", "vs", "sizes", "qids", "qs", "bounds")
    out = stash(pairs.mapInArrow(rerank, met))
    release(packed, bounds)
    return ranked(out).select("query_id", "rank", "vec_id", "score")
