"""Helpers that the operators share: stashed tables, Arrow text buffers, word and n-gram hashes."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: space and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
NULL_ID, LONG_WORD = 2**63 - 1, 256
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _BASE2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a local one for a local master, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="callgrid-")
        shared_dir.own = where
    return where.rstrip("/")


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, rows: float | None = None) -> DataFrame:
    """Writes a table into the shared folder and reads it again: lineage ends there, and the table
    outlives any executor. The shuffle files of the job go with it. rows: a bound on small rows, so
    that a table of few rows is written by few tasks, though never by fewer than there are cores."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    few = df if rows is None else df.coalesce(max(8, spark.sparkContext.defaultParallelism, math.ceil(rows / 50_000)))
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        few.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for table in tables:
        path = getattr(table, "_stash", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def order_id(col: str | Column) -> Column:
    """A document's identifier for ordering; null comes after every other."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID)).cast("long")


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def carried(columns: list[str], outputs: tuple[str, ...] = ()) -> Column:
    """The columns as one struct, out of reach of an operator's own names; a column whose name is
    among the outputs is left out, as the output takes its place."""
    taken = {x.lower() for x in outputs}
    return F.struct(*[quoted(c).alias(c) for c in columns if c.lower() not in taken])


def n_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            both = []
            for b in (base, pow(base, -1, 2**64)):
                p = np.full(size, np.uint64(b), dtype=np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
        have = _powers[base] = (both[0], both[1])
    return have


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """A hash of values[start:end] for many ranges at once, by prefix sums of a polynomial."""
    p, ip = powers(base, len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=total[1:])
        h = (total[end] - total[start]) * ip[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text or binary column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most so many bytes of text, or one row."""
    off, _ = text_buffers(batch.column(text)) if batch.num_rows else (np.zeros(1, np.int64), None)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of its first word
    (one more entry than texts)."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(off), np.int64)
    ink = ~_WS[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[off] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, ink[:-1]
    starts = np.flatnonzero(ink & (~before | first[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, ink[1:]
    ends = np.flatnonzero(ink & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of every word, as two numbers: its bytes go through two mixers, eight at a time; words of
    more than LONG_WORD bytes are hashed one by one."""
    n = ends - starts
    one, two = mix(n.astype(np.uint64) + np.uint64(_BASE)), mix(n.astype(np.uint64) + np.uint64(_BASE2))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at, each = np.flatnonzero(n <= LONG_WORD), np.arange(8)
    done = 0
    with np.errstate(over="ignore"):
        while len(at):
            rest = np.minimum(n[at] - done, 8)
            part = padded[(starts[at] + done)[:, None] + each].view(np.uint64)[:, 0]
            part &= np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * rest.astype(np.uint64))
            one[at] = mix(one[at] ^ part)
            two[at] = mix(two[at] * np.uint64(_BASE) + part)
            done += 8
            at = at[n[at] > done]
    for i in np.flatnonzero(n > LONG_WORD):
        one[i], two[i] = np.frombuffer(xxhash.xxh3_128_digest(data[starts[i] : ends[i]].tobytes()), np.uint64)
    return one, two


def tree_hash(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of values[start : start + length] for many ranges, by mixed pairs of halves: unlike
    range_hash it is no polynomial, so that ranges that are alike under both are alike."""
    level, span, out = mix(values), 1, np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        while True:
            own = np.flatnonzero((length >= span) & (length < 2 * span))
            left, right = level[start[own]], level[start[own] + length[own] - span]
            out[own] = mix(left * np.uint64(_BASE) + mix(right + length[own].astype(np.uint64)))
            if not (length >= 2 * span).any():
                return out
            level = mix(level[:-span] * np.uint64(_BASE2) + mix(level[span:] + np.uint64(span)))
            span *= 2


def grams(wh: np.ndarray, k: int, base: int = _BASE2) -> np.ndarray:
    """Hashes of all runs of k word hashes."""
    n = max(0, len(wh) - k + 1)
    at = np.arange(n)
    return range_hash(wh, at, at + k, base)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def crc_bucket(col: str, n: int = 5) -> Column:
    return F.crc32(F.col(col).cast("string")) % n


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
