"""Embedding whitening by a randomised range finder.

Entries become whole numbers, floor(scale * c). The fit list holds every distinct vector of them once. A
pass deals the fit list out, centres each row before it is multiplied, and adds up rows' (x - m) (x - m)' Q
for a basis Q; only such sums, dimension by columns, reach the driver. The range finder starts from
random directions, some more than the components asked for (oversampling), and repeats passes (powers),
each orthonormalised. Rayleigh-Ritz in the basis gives values and directions; if a residual exceeds the
tolerance, the basis is widened to the full dimension, where Rayleigh-Ritz has no residual but rounding.
Sums of the fit list, and deviations, are exact. One more pass measures how far the whitened fit list is
from unit covariance.

Vectors that are null or hold null or non-finite entries take no part, and of vectors of several lengths
only those of the commonest (ties: the longest). Repeated rows and rows without an identifier are whitened as any other. Directions
without variance (one distinct vector, constant entries) have explained 0 and whitened null; they are
left out of the measure. With fewer entries than components asked for there are as many as entries. An
entry beyond the range of a long becomes its nearest end; a deviation beyond it is null. Whoever has
vectors of more than `most` entries (4,096; tables of most x most numbers on the driver) gets an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrid.llm.common import carried, release, stash

MOST, BLOCK = 4096, 1 << 20
_TYPES = [np.dtype(t) for t in ("<i1", "<i2", "<i4", "<i8")]


def usable(vec_col: str):
    vec = F.col(vec_col)
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    big = np.floor(values.astype(np.float64) * scale)
    with np.errstate(invalid="ignore"):
        x = np.where(np.abs(big) < 2.0**63, big, 0.0).astype(np.int64)
    x[big >= 2.0**63] = 2**63 - 1
    x[big < -(2.0**63)] = -(2**63)
    return x


def packed(x: np.ndarray) -> list[bytes]:
    """Rows of whole numbers as bytes, each in the narrowest type that holds it; equal rows are equal bytes."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes] = [b""] * len(x)
    open_ = np.ones(len(x), bool)
    for kind in _TYPES:
        ends = np.iinfo(kind)
        fits = np.flatnonzero(open_ & (low >= ends.min) & (high <= ends.max))
        open_[fits] = False
        for i, row in zip(fits.tolist(), x[fits].astype(kind)):
            out[i] = row.tobytes()
    return out


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    out = np.empty((len(column), dim), np.int64)
    rows = column.to_pylist()
    size = np.array([len(r) for r in rows])
    for kind in _TYPES:
        at = np.flatnonzero(size == dim * kind.itemsize)
        out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(len(at), dim)
    return out


class Fit:
    """The fit list and its centre, and passes over it."""

    def __init__(self, vectors: DataFrame, vec_col: str, scale: float, most: int):
        self.vec_col, self.scale, self.table, self.n, self.total = vec_col, scale, None, 0, []
        rows = vectors.filter(usable(vec_col)).filter(F.size(vec_col) > 0)
        lengths = rows.groupBy(F.size(vec_col).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
        self.dim = dim = lengths[0]["dim"] if lengths else 0
        if dim > most:
            raise ValueError(f"more than {most} entries")
        if not dim:
            return

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = whole(np.asarray(batch.column("v").flatten()).reshape(-1, dim), scale)
                    yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary())], ["x"])

        own = rows.filter(F.size(vec_col) == dim).select(F.col(vec_col).alias("v"))
        self.table = stash(own.mapInArrow(pack, "x binary").distinct())

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, high, low = 0, np.zeros(dim, object), np.zeros(dim, object)
            for batch in batches:
                x = unpacked(batch.column("x"), dim)
                n += len(x)
                high += (x >> 32).sum(axis=0).astype(object)
                low += (x & 0xFFFFFFFF).sum(axis=0).astype(object)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([0]), pa.array([-1])], ["total", "low", "at"])
            yield pa.RecordBatch.from_arrays([pa.array(high.tolist(), pa.int64()), pa.array(low.tolist(), pa.int64()), pa.array(np.arange(dim))], ["total", "low", "at"])

        exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        got = {r["at"]: int(r["total"] or 0) * (1 if r["at"] < 0 else 2**32) + int(r["low"] or 0) for r in self.table.mapInArrow(sums, "total long, low long, at long").groupBy("at").agg(exact("total"), exact("low")).collect()}  # dim + 1 rows
        self.n, self.total = got[-1], [got[i] for i in range(dim)]
        self.centre = np.array([s / self.n for s in self.total])

    def products(self, basis: np.ndarray) -> np.ndarray:
        """The covariance of the fit list times a basis."""
        dim, columns, centre = self.dim, basis.shape[1], self.centre

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, step = np.zeros((dim, columns)), max(1, BLOCK // dim)
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    c = unpacked(batch.column("x").slice(lo, step), dim) - centre
                    total += c.T @ (c @ basis)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * columns)), pa.array(total.ravel())], ["at", "v"])

        got = self.table.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # dim * columns rows
        out = np.zeros(dim * columns)
        out[np.asarray(got.column("at"))] = np.asarray(got.column("v"))
        return out.reshape(dim, columns) / self.n

    def measure(self, directions: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, float]:
        """The covariance of the whitened fit list, and the covariance's trace."""
        dim, k, centre = self.dim, directions.shape[1], self.centre

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, second, trace, step = np.zeros(k), np.zeros((k, k)), 0.0, max(1, BLOCK // dim)
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    c = unpacked(batch.column("x").slice(lo, step), dim) - centre
                    w = c @ directions / roots
                    first, second, trace = first + w.sum(axis=0), second + w.T @ w, trace + (c**2).sum()
            flat = np.concatenate([[trace], first, second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "v"])

        got = {r["at"]: r["v"] / self.n for r in self.table.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()}
        mean = np.array([got[1 + i] for i in range(k)])
        return np.array([got[1 + k + i] for i in range(k * k)]).reshape(k, k) - np.outer(mean, mean), got[0]


def fit(vectors: DataFrame, vec_col: str = "embedding", components: int = 4, scale: float = 256.0, oversample: int = 10, powers: int = 2, tolerance: float = 1e-12, most: int = MOST, seed: int = 29) -> dict:
    """Components of the distinct vectors: directions, values, explained shares, the sums of the fit list."""
    data = Fit(vectors, vec_col, scale, most)
    dim = data.dim
    model = {"dim": dim, "scale": scale, "n": data.n, "total": data.total, "directions": np.zeros((dim, 0)), "values": np.zeros(0), "explained": np.zeros(0), "identity_error": 0.0, "widened": False}
    if not dim:
        return model
    k = min(components, dim)
    rng = np.random.default_rng(seed)
    basis, _ = np.linalg.qr(rng.standard_normal((dim, min(dim, k + oversample))))
    for _ in range(powers + 1):
        basis, _ = np.linalg.qr(data.products(basis))
    values, directions, residual = ritz(data, basis)
    scale_of = max(values.max(initial=0.0), 1e-300)
    if basis.shape[1] < dim and residual[:k].max() > tolerance * scale_of:
        model["widened"] = True
        rest, _ = np.linalg.qr(np.hstack([basis, rng.standard_normal((dim, dim - basis.shape[1]))]))
        values, directions, _ = ritz(data, rest)
    values, directions = values[:k], directions[:, :k]
    live = values > 1e-12 * scale_of if values.max(initial=0.0) > 0 else np.zeros(k, bool)
    covariance, trace = data.measure(directions[:, live], np.sqrt(values[live]))
    release(data.table)
    off = np.abs(covariance - np.eye(int(live.sum())))
    return model | {"directions": directions, "values": np.where(live, values, 0.0), "explained": np.where(live, values, 0.0) / (trace or 1.0), "identity_error": float(off.max(initial=0.0))}


def ritz(data: Fit, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (falling), directions and residuals of the covariance in a basis."""
    image = data.products(basis)
    small = basis.T @ image
    values, inner = np.linalg.eigh((small + small.T) / 2)
    values, inner = values[::-1], inner[:, ::-1]
    return values, basis @ inner, np.linalg.norm(image @ inner - (basis @ inner) * values, axis=0)


OUTPUTS = ("deviation", "whitened")


def whiten(vectors: DataFrame, model: dict, keep: list[str], vec_col: str = "embedding") -> DataFrame:
    """The columns named in `keep`, then deviation (from the centre, n times, squared) and whitened (an
    entry for each component), of every row that takes part."""
    dim, scale, n = model["dim"], model["scale"], model["n"]
    rows = vectors.filter(usable(vec_col)).filter((F.size(vec_col) == dim) & F.lit(dim > 0)).select(carried(keep, OUTPUTS).alias("_row"), F.col(vec_col).alias("_v"))
    schema = T.StructType([rows.schema["_row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    live = model["values"] > 0
    k = len(live)
    turn = model["directions"] / np.sqrt(np.where(live, model["values"], 1.0))
    total = np.array(model["total"], dtype=object)
    centre = np.array([s / n for s in model["total"]])

    def deviations(x: np.ndarray) -> list[int | None]:
        """Exact; in machine numbers where no sum can leave their range."""
        reach = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(abs(int(s)) for s in total)
        if reach**2 * dim < 2**63:
            return ((n * x - total.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((x.astype(object) * n - total) ** 2).sum(axis=1).tolist()
        return [d if d < 2**63 else None for d in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // max(1, dim))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                x = whole(np.asarray(part.column("_v").flatten()).reshape(-1, dim), scale)
                w = (x - centre) @ turn
                flat = pa.array(w.ravel(), mask=np.tile(~live, len(w)))
                edge = pa.array((np.arange(len(w) + 1) * k).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(deviations(x), pa.int64()), pa.ListArray.from_arrays(edge, flat)], ["_row", *OUTPUTS])

    return rows.mapInArrow(run, schema).select("_row.*", *OUTPUTS)
