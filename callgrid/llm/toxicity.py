"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and its distinct five-byte pieces of words (a word's beginning counts
as a byte), ASCII letters lower-cased, hashed to 2 ** 20 numbers. Of these the machine's inputs are those that
tell the labels apart in the training rows beyond chance (chi-squared of `least_chi`, p about 0.0001, in
`least_rows` rows at least), the clearest `kept` of them. Its score adds a weight for each
term that a text has and, for each pair of them, the product of two short vectors: an insult beside the
mention of a group can weigh more than both alone, which additive weights can't express. Weights and
vectors minimise the logistic loss with a penalty, by AdaGrad over small batches.

The machine learns from a bounded sample of labelled rows (`max_train`, smallest hashes of the
identifier; of rows that share an identifier, the smallest text); scores cover every whole text. Null
and empty texts, and those without a term that counts, score as the bias says. Without labels of both
kinds every text scores the share of label 1 (0 without any). A document labelled twice counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import range_hash, release, slices, stash, text_buffers, text_of

MAX_TRAIN, KEPT, LEAST_CHI, LEAST_ROWS, BUCKETS, PIECE, FACTORS = 20_000, 4096, 15.0, 3, 20, 5, 8
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def terms(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the term's number of every occurrence."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    # a blank before every text, so that none runs into the next
    d = np.full(len(data) + n + 1, 32, np.uint8)
    d[np.arange(len(data)) + row + 1] = _FOLD[data]
    blank = d == 32
    begins = off[:-1] + np.arange(n)
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    word = (range_hash(d, starts, ends) >> np.uint64(64 - BUCKETS)).astype(np.int64)
    at = np.flatnonzero(~(blank[1:-3] | blank[2:-2] | blank[3:-1] | blank[4:])) if len(d) >= PIECE else np.zeros(0, np.int64)
    code = np.zeros(len(at), np.uint64)
    for i in range(PIECE):
        code = (code << np.uint64(8)) | d[at + i].astype(np.uint64)
    with np.errstate(over="ignore"):
        piece = ((code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS)).astype(np.int64)
    owner = np.searchsorted(begins, np.concatenate([starts, at]), side="right") - 1
    return owner, np.concatenate([word, piece])


def inputs(off: np.ndarray, data: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges and the distinct terms of each text, in order. known: for each term its number as an input, or -1."""
    n = len(off) - 1
    owner, term = terms(off, data)
    if known is not None:
        term = known[term]
        owner, term = owner[term >= 0], term[term >= 0]
    both = np.unique((owner << BUCKETS) | term)
    return np.searchsorted(both >> BUCKETS, np.arange(n + 1)), both & ((1 << BUCKETS) - 1)


class Machine:
    def __init__(self, known: np.ndarray, bias: float, size: int, factors: int = FACTORS, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.known, self.bias = known, bias
        self.w, self.v = np.zeros(size), rng.normal(0, 0.05, (size, factors))

    def margins(self, edges: np.ndarray, term: np.ndarray) -> np.ndarray:
        add = lambda x: np.add.reduceat(np.concatenate([x, np.zeros((1, *x.shape[1:]))]), edges[:-1]) * (np.diff(edges) > 0).reshape(-1, *[1] * (x.ndim - 1))
        v = self.v[term]
        return self.bias + add(self.w[term]) + 0.5 * (add(v) ** 2 - add(v**2)).sum(axis=1)

    def fit(self, edges: np.ndarray, term: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, penalty: float = 2e-5, seed: int = 13) -> None:
        rng = np.random.default_rng(seed)
        n, gw, gv, gb = len(y), np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(n)
            for lo in range(0, n, batch):
                rows = order[lo : lo + batch]
                size = edges[rows + 1] - edges[rows]
                of = np.repeat(np.arange(len(rows)), size)
                first = np.concatenate([[0], np.cumsum(size)])
                t = term[np.repeat(edges[rows] - first[:-1], size) + np.arange(len(of))]
                margin = self.margins(first, t)
                err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]
                gb += (g := err.mean()) ** 2
                self.bias -= rate * g / np.sqrt(gb)
                if not len(t):
                    continue
                v = self.v[t]
                total = np.zeros((len(rows), v.shape[1]))
                np.add.at(total, of, v)
                some, which = np.unique(t, return_inverse=True)
                gone = np.bincount(which, weights=err[of]) / len(rows) + penalty * self.w[some]
                gw[some] += gone**2
                self.w[some] -= rate * gone / np.sqrt(gw[some])
                each = err[of][:, None] * (total[of] - v)
                grad = np.stack([np.bincount(which, weights=each[:, f]) for f in range(v.shape[1])], axis=1) / len(rows) + penalty * self.v[some]
                gv[some] += grad**2
                self.v[some] -= rate * grad / np.sqrt(gv[some])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, kept: int = KEPT, least_chi: float = LEAST_CHI, least_rows: int = LEAST_ROWS) -> Machine:
    """labels: the rows to learn from, with id_col and label_col (0 or 1)."""
    some = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_train).groupBy("_id", "_y").agg(F.count(F.lit(1)).cast("int").alias("_times"))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(some), "_id")  # max_train rows
    rows = rows.groupBy("_id", "_y", "_times").agg(F.min("_text").alias("_text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                edges, term = inputs(*text_buffers(part.column("_text")))
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), part.column("_times"), lists], ["_id", "_y", "_times", "terms"])

    kind = docs.schema[id_col].dataType.simpleString()
    seen = stash(rows.select("_id", "_y", "_times", "_text").mapInArrow(measure, f"_id {kind}, _y int, _times int, terms array<int>"))
    n = {r["_y"]: r["n"] for r in seen.groupBy("_y").agg(F.sum("_times").alias("n")).collect()}
    known, ones, zeros = np.full(1 << BUCKETS, -1, np.int32), n.get(1, 0), n.get(0, 0)
    if not ones or not zeros:
        release(seen)
        return Machine(known, 30.0 if ones else -30.0, 0)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((2, 1 << BUCKETS))
        for batch in batches:
            if batch.num_rows:
                each = np.diff(np.asarray(batch.column("terms").offsets))
                y, times = np.repeat(np.asarray(batch.column("_y")), each), np.repeat(np.asarray(batch.column("_times")), each)
                term = np.asarray(batch.column("terms").flatten())
                for k in (0, 1):
                    c[k] += np.bincount(term[y == k], weights=times[y == k], minlength=1 << BUCKETS)
        at = np.flatnonzero(c.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(c[1, at].astype(np.int64)), pa.array(c[0, at].astype(np.int64))], ["term", "a", "b"])

    table = seen.mapInArrow(counts, "term int, a long, b long").groupBy("term").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    without = (F.lit(float(ones)) - F.col("a"), F.lit(float(zeros)) - F.col("b"))
    apart = F.col("a") * without[1] - F.col("b") * without[0]
    table = table.withColumn("chi", apart * apart / ((F.col("a") + F.col("b")) * F.greatest(without[0] + without[1], F.lit(0.5))))
    best = table.filter((F.col("chi") >= least_chi) & (F.col("a") + F.col("b") >= least_rows)).orderBy(F.desc("chi"), "term").limit(kept).collect()  # kept rows
    known[[r["term"] for r in best]] = np.arange(len(best))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edge, term = np.asarray(batch.column("terms").offsets), known[np.asarray(batch.column("terms").values)]
            fine = np.concatenate([[0], np.cumsum(term >= 0)])
            lists = pa.ListArray.from_arrays(pa.array(fine[edge].astype(np.int32)), pa.array(term[term >= 0].astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), batch.column("_times"), lists], ["_id", "_y", "_times", "terms"])

    got = seen.mapInArrow(narrowed, f"_id {kind}, _y int, _times int, terms array<smallint>").toArrow().combine_chunks().sort_by([("_id", "ascending"), ("_y", "ascending")])  # max_train rows of kept numbers at most
    release(seen)
    got = got.take(pa.array(np.repeat(np.arange(got.num_rows), np.asarray(got.column("_times"))))).combine_chunks()
    column = got.column("terms").combine_chunks() if isinstance(got.column("terms"), pa.ChunkedArray) else got.column("terms")
    edges = np.concatenate([[0], np.cumsum(np.diff(np.asarray(column.offsets)))])
    machine = Machine(known, float(np.log(ones / zeros)), len(best))
    machine.fit(edges, np.asarray(column.flatten()).astype(np.int64), np.asarray(got.column("_y")).astype(float))
    return machine


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                margin = machine.margins(*inputs(*text_buffers(part.column("_text")), machine.known))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")).mapInArrow(run, f"doc_id {kind}, score double")
