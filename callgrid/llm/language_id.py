"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary n-gram classifier (log odds of hashed byte
trigrams, smoothed) tells the languages with a one from those with a zero. Trigram counts come from all
training documents, each document with equal weight. Decoding is loss-weighted: the bits' logistic
losses, each weighted by how well its classifier tells the training languages apart, are summed against
every codeword; the nearest one wins, and a small lead over the second flags the text as ambiguous.

Text that is null or has no letter is `und` with score 0. Texts too short for a trigram, and ties, go
to the more frequent language and are ambiguous. Without training rows every text is `und`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrid.llm.common import carried, slices, text_buffers, text_of

DIM, UNKNOWN, SCALE, MAX_LANGUAGES = 1 << 14, "und", 24.0, 1024
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigrams(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number of each byte trigram inside a text, and the text's number of them."""
    size = np.maximum(np.diff(off) - 2, 0)
    if len(data) < 3:
        return np.zeros(0, np.int64), size
    d = _LOWER[data].astype(np.uint32)
    code = (d[:-2] << 16) | (d[1:-1] << 8) | d[2:]
    with np.errstate(over="ignore"):
        f = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
    ok = np.ones(len(d), dtype=bool)
    inner = off[1:]
    ok[inner[inner >= 1] - 1] = False
    ok[inner[inner >= 2] - 2] = False
    return f[ok[:-2]].astype(np.int64), size


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits for few languages, else random ones kept far apart."""
    if n <= 6:
        bits = [[1 if (m >> i) & 1 else -1 for i in range(n)] for m in range(1, 2 ** max(0, n - 1))]
        return np.array(bits or [[1] * n]).T
    rng, width = np.random.default_rng(5), max(15, math.ceil(10 * math.log2(n)))
    out = [rng.choice([-1, 1], width)]
    while len(out) < n:
        some = rng.choice([-1, 1], (64, width))
        out.append(some[int(np.argmax([(np.array(out) != s).sum(1).min() for s in some]))])
    return np.array(out)


def language_counts(train: DataFrame, text: str, lang: str, langs: list[str]) -> np.ndarray:
    """Trigram weights by language over all training rows, each row of equal weight."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) * DIM)
        at = {x: i for i, x in enumerate(langs)}
        for batch in batches:
            for part in slices(batch, text):
                f, size = trigrams(*text_buffers(part.column(text)))
                of = np.repeat(np.array([at[x] for x in part.column(lang).to_pylist()], dtype=np.int64), size)
                weight = np.repeat(np.floor(2.0**20 / np.maximum(size, 1)), size)
                total += np.bincount(of * DIM + f, weights=weight, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["at", "w"])

    got = train.mapInArrow(count, "at long, w long").groupBy("at").agg(F.sum("w").alias("w")).toPandas()  # languages * DIM rows at most
    out = np.zeros(len(langs) * DIM)
    out[got["at"].to_numpy(dtype=np.int64)] = got["w"].to_numpy(dtype=np.float64)
    return out.reshape(len(langs), DIM)


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> dict:
    """The model. Tables of max_languages * DIM numbers are held in a task and on the driver (128 MB at the
    default); a corpus with more languages is an error, and takes a larger bound."""
    rows = docs.filter(train).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    seen = rows.groupBy("_lang").count().limit(max_languages + 1).collect()
    if len(seen) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    langs = [r["_lang"] for r in sorted(seen, key=lambda r: (-r["count"], r["_lang"]))]
    if not langs:
        return {"langs": [], "code": np.zeros((0, 0)), "w": np.zeros((DIM, 0), np.float32), "trust": np.zeros(0)}
    c = language_counts(rows, "_text", "_lang", langs)
    p = (c + 1.0) / (c + 1.0).sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    smooth = 0.1 / DIM
    w = np.zeros((DIM, code.shape[1]), dtype=np.float32)
    for b in range(code.shape[1]):
        one, zero = p[code[:, b] > 0], p[code[:, b] < 0]
        if len(one) and len(zero):
            w[:, b] = np.log((one.mean(0) + smooth) / (zero.mean(0) + smooth))
    # a bit's weight: its mean margin over the languages' own distributions
    trust = np.maximum((p @ w * code).min(axis=0), 1e-3)
    return {"langs": langs, "code": code, "w": w, "trust": trust / trust.sum()}


def decode(model: dict, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number, score and lead of each text."""
    f, size = trigrams(off, data)
    edge = np.concatenate([[0], np.cumsum(size)])
    margin = np.empty((len(size), model["w"].shape[1]))
    for b in range(margin.shape[1]):
        total = np.concatenate([[0.0], np.cumsum(model["w"][f, b], dtype=np.float64)])
        margin[:, b] = (total[edge[1:]] - total[edge[:-1]]) / np.maximum(size, 1)
    loss = np.logaddexp(0, -SCALE / 4 * margin[:, None, :] * model["code"][None]) @ model["trust"]
    share = np.exp(-SCALE * (loss - loss.min(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    ranked = np.sort(share, axis=1)
    lead = ranked[:, -1] - ranked[:, -2] if share.shape[1] > 1 else np.ones(len(size))
    return best, np.clip(share[np.arange(len(size)), best], 0, 1), lead


OUTPUTS = ("lang_pred", "score", "ambiguous")


def decoded(docs: DataFrame, model: dict, row: Column, text_col: str, least_lead: float) -> DataFrame:
    """_row, lang_pred, score and ambiguous of every text."""
    rows = docs.select(row.alias("_row"), text_of(text_col).alias("_text"), text_of(text_col).rlike(r"\p{L}").alias("_letters"))
    schema = T.StructType([rows.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model["langs"], UNKNOWN], dtype=object)
        for batch in batches:
            for part in slices(batch, "_text"):
                letters = np.asarray(part.column("_letters")).astype(bool) if len(langs) > 1 else np.zeros(part.num_rows, bool)
                if len(langs) > 1:
                    best, score, lead = decode(model, *text_buffers(part.column("_text")))
                else:
                    best, score, lead = (np.zeros(part.num_rows, np.int64), *np.zeros((2, part.num_rows)))
                best = np.where(letters, best, len(langs) - 1)
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(list(langs[best]), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(~letters | (lead < least_lead))], ["_row", *OUTPUTS])

    return rows.mapInArrow(run, schema)


def predict(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", least_lead: float = 0.2) -> DataFrame:
    """The columns named in `keep`, then lang_pred, score and ambiguous, of every text."""
    return decoded(docs, model, carried(keep, OUTPUTS), text_col, least_lead).select("_row.*", *OUTPUTS)


def identified(docs: DataFrame, model: dict, text_col: str = "text", least_lead: float = 0.2) -> DataFrame:
    """The documents, all columns as they are, whose language is found and not in doubt."""
    return decoded(docs, model, carried(docs.columns), text_col, least_lead).filter(f"lang_pred <> '{UNKNOWN}' and not ambiguous").select("_row.*")
