"""Quality scores by Bradley-Terry pairwise ranking.

Pairs of a document with label 1 and one with label 0 are preferences. The score of a document is
linear in its features, and the weights minimise the logistic loss on feature differences (with a small
penalty). The threshold is the score quantile at the share of label 0 among the training rows; a
logistic curve puts that quantile at the asked cut-off, so that scores lie between 0 and 1.

The ranking learns from a bounded sample of labelled rows (`max_train`, smallest hashes of the
identifier); scores cover every whole text. Null and empty texts have all features zero and get a
score as any other. Without labels of both kinds every score is the cut-off. A document labelled twice
counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import range_hash, slices, text_buffers, text_of, words

MAX_TRAIN, PAIRS = 20_000, 60_000
_MARKS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
N_FEATURES = 14 + len(_MARKS)


def features(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row a text: shares of kinds of bytes and words, repetition, lengths, and marks."""
    n = len(off) - 1
    out = np.zeros((n, N_FEATURES))
    if not len(data):
        return out
    size = np.maximum(np.diff(off), 1)
    row = np.repeat(np.arange(n), np.diff(off))
    hist = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    starts, ends, first = words(off, data)
    count = np.diff(first)
    n_words = np.maximum(count, 1)
    of = np.repeat(np.arange(n), count)
    share = lambda flags, who=of: np.bincount(who, weights=flags, minlength=n) / n_words
    upper, lower = hist[:, 65:91].sum(1), hist[:, 97:123].sum(1)
    out[:, 0] = np.log1p(count)
    out[:, 1] = np.bincount(of, weights=ends - starts, minlength=n) / n_words
    out[:, 2] = upper / size
    out[:, 3] = upper / np.maximum(upper + lower, 1)
    out[:, 4] = hist[:, 48:58].sum(1) / size
    out[:, 5] = hist[:, 128:].sum(1) / size
    out[:, 6] = hist[:, 10] / n_words
    if len(starts):
        wh = range_hash(data, starts, ends)
        same = np.zeros(len(wh))
        same[1:] = (wh[1:] == wh[:-1]) & (of[1:] == of[:-1])
        out[:, 7] = share(same)
        order = np.lexsort((wh, of))
        w, o = wh[order], of[order]
        new = np.ones(len(w))
        new[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
        out[:, 8] = share(new, o)
        out[:, 9] = out[:, 8] * np.log1p(count)
        head, tail = data[starts], data[ends - 1]
        out[:, 10] = share(((head >= 65) & (head <= 90)).astype(float))
        plain = ((tail >= 97) & (tail <= 122)) | (tail >= 128)
        out[:, 11] = share((~plain).astype(float))
        out[:, 12] = share((tail == 46).astype(float))
        long_ = np.zeros(n)
        np.maximum.at(long_, of, ends - starts)
        out[:, 13] = np.log1p(long_)
    out[:, 14:] = np.sqrt(hist[:, _MARKS] / size[:, None])
    return out


def fit_ranking(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 1e-2, seed: int = 3) -> dict:
    """Weights, and the score at the threshold's quantile."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return {"w": np.zeros(x.shape[1]), "cut": 0.0}
    spread = x.std(axis=0)
    unit = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
    rng = np.random.default_rng(seed)
    d = (x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]) * unit
    w = np.zeros(x.shape[1])
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w)), d.T @ (p - 1) / pairs + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    w = w * unit
    return {"w": w, "cut": float(np.quantile(x @ w, (y == 0).mean()))}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> dict:
    """labels: the rows to learn from, with id_col and label_col (0 or 1)."""
    some = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
    some = some.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_train)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(some), "_id")  # max_train rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                x = features(*text_buffers(part.column("_text")))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["_id", "_y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select("_id", "_y", "_text").mapInArrow(measure, f"_id {kind}, _y int, x array<double>").toPandas().sort_values(["_id", "_y"])
    x = np.array(got["x"].tolist()).reshape(len(got), N_FEATURES)
    return fit_ranking(x, got["_y"].to_numpy())


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", cutoff: float = 0.3) -> DataFrame:
    """doc_id and score of every document; a score of `cutoff` stands at the threshold."""
    base = np.log(cutoff / (1 - cutoff))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                s = features(*text_buffers(part.column("_text"))) @ model["w"] - model["cut"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(s + base, -700, 700))))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_text")).mapInArrow(run, f"doc_id {kind}, score double")
