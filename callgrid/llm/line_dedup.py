"""Line dedup over a suffix array of line sequences.

The lines of all documents form sequences of line keys (128 bits of the trimmed line; blank lines are
not part of them). Of documents with one text (by 128 bits of it) only the first takes part: every run of the
others starts earlier in it, so these are repeats as a whole. A line that occurs once ends every repeat, so only suffixes that begin with a
repeated line are kept. Prefix doubling ranks them by their first 1, 2, 4, ... lines: pairs of ranks are
counted and sorted as distinct values over the cluster, and a rank is a value's place in that order. It
goes on until no run of the length is shared. The order by the last ranks is the suffix array; the
longest common prefix of neighbours in it is read from the ranks of all lengths, the longest first.

Neighbours whose common prefix reaches `min_lines` form an interval: all its suffixes begin with the same
run. The one that starts first (smallest identifier, then position) stays, and the runs at the others
are repeats; overlapping and touching ones make up the maximal repeated runs, and their lines are deleted.

Null and empty texts have no lines. Blank lines are kept. A null identifier comes after all others. Rows
that share identifier and text are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import _WS, n_parts, order_id, release, slices, stash, text_buffers, text_of
from callgrid.llm.running import running_totals

MIN_LINES, WHOLE = 1, -1


def lines(off: np.ndarray, data: np.ndarray):
    """Trimmed lines that are not blank: starts and ends; the line number in its text; the text's
    first such line; and byte edges of all lines."""
    stop = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([off[:-1], stop + 1]))
    doc = np.searchsorted(off, begin, side="right") - 1
    begin = begin[(begin < len(data))]
    end = np.minimum(np.append(stop, len(data))[np.searchsorted(stop, begin)], off[np.searchsorted(off, begin, side="right")]) if len(begin) else begin
    ink = np.flatnonzero(~_WS[data])
    lo, hi = np.searchsorted(ink, begin), np.searchsorted(ink, end)
    full = np.flatnonzero(hi > lo)
    return ink[lo[full]] if len(full) else full, ink[hi[full] - 1] + 1 if len(full) else full, begin, end, full


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """Runs of min_lines lines that occur earlier: _id, _th, pos (the number of the run's first line; WHOLE for all
    runs of a document whose text an earlier one has)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                off, data = text_buffers(part.column("_text"))
                s, e, *_ = lines(off, data)
                of = np.searchsorted(off, s, side="right") - 1
                pos = np.arange(len(s)) - np.searchsorted(s, off)[of]
                take = pa.array(of)
                view = memoryview(np.ascontiguousarray(data))
                key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(s.tolist(), e.tolist())), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column("_id").take(take), part.column("_th").take(take), pa.array(pos.astype(np.int32)), pa.array(key[:, 0]), pa.array(key[:, 1])], ["_id", "_th", "pos", "r1", "r2"])

    keyed = docs.select(order_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_th"), text_of(text_col).alias("_text"))
    copies = copied(keyed)
    found = keyed.mapInArrow(keys, "_id long, _th long, pos int, r1 long, r2 long")
    twice = stash(found.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    # copies leave once the lines that occur once have left, so that few rows are dealt out for it
    rest = stash(found.join(twice, ["r1", "r2"]).join(copies, ["_id", "_th"], "left_anti"))
    array = suffix_array(rest)
    release(twice, rest)
    # neighbours with a shorter common prefix begin another interval
    bounds = array.withColumns({"_all": F.lit(0), "_new": (F.col("lcp") < min_lines).cast("long")})
    placed = running_totals(bounds, "_all", ["place"], {"_before": "_new"}).withColumn("interval", F.col("_before") + F.col("_new"))
    at = F.struct("_id", "_th", "pos")
    first = placed.groupBy("interval").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    runs = placed.join(stash(first.drop("c")), "interval").filter(at > F.col("first")).select("_id", "_th", "pos")
    return runs.unionByName(copies.withColumn("pos", F.lit(WHOLE)))


def copied(keyed: DataFrame) -> DataFrame:
    """_id, _th of the documents whose text an earlier one has, each once."""
    texts = keyed.select("_id", "_th", F.unhex(F.md5("_text")).alias("_md"))
    at = F.struct("_id", "_th")
    # a table of its own, so that a join with a text of very many copies can be cut
    first = stash(texts.groupBy("_md").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c"))
    out = stash(texts.join(first, "_md").filter(at > F.col("first")).select("_id", "_th").distinct())
    release(first)
    return out


def suffix_array(lines_: DataFrame) -> DataFrame:
    """lines_: _id, _th, pos and a line's key (r1, r2). The suffixes that begin with a repeated line: _id,
    _th, pos, place (0, 1, ... in the array) and lcp (lines in common with the suffix before it)."""
    levels = [ranks(lines_, distinct_rows=True)]
    span = 1
    while True:
        now = levels[-1]
        # what lies span lines on, if all lines up to there are repeated ones; else the suffix has ended
        ahead = now.select("_id", "_th", (F.col("pos") - span).alias("pos"), F.col("rank").alias("r2"), F.col("full").alias("_far"))
        both = now.join(ahead, ["_id", "_th", "pos"], "left")
        r2 = F.when(F.col("full"), F.coalesce("r2", F.lit(-1))).otherwise(-1)
        final = ranks(both.select("_id", "_th", "pos", F.col("rank").alias("r1"), r2.alias("r2"), (F.col("full") & F.coalesce(F.col("_far"), F.lit(False))).alias("full")))
        if final.filter("full").groupBy("rank").count().filter("count > 1").isEmpty():
            break
        levels.append(final)
        span *= 2
    # dense places in the order of the longest ranks; those that end together by place in the documents
    order = ["rank", "_id", "_th", "pos"]
    ordered = stash(running_totals(final.withColumns({"_all": F.lit(0), "_one": F.lit(1).cast("long")}), "_all", order, {"place": "_one"}).select("_id", "_th", "pos", "place"))
    before = ordered.select((F.col("place") + 1).alias("place"), F.col("_id").alias("_pid"), F.col("_th").alias("_pth"), F.col("pos").alias("_ppos"))
    pairs = stash(ordered.join(before, "place", "left").withColumn("lcp", F.lit(0)))
    for level in reversed(levels):
        whole = level.filter("full").select("_id", "_th", "pos", "rank")
        here = pairs.withColumn("_at", F.col("pos") + F.col("lcp")).join(whole.select("_id", "_th", F.col("pos").alias("_at"), F.col("rank").alias("_r")), ["_id", "_th", "_at"], "left")
        there = whole.select(F.col("_id").alias("_pid"), F.col("_th").alias("_pth"), F.col("pos").alias("_pat"), F.col("rank").alias("_pr"))
        both = here.withColumn("_pat", F.col("_ppos") + F.col("lcp")).join(there, ["_pid", "_pth", "_pat"], "left")
        longer = F.when(F.col("_r") == F.col("_pr"), F.col("lcp") + span).otherwise(F.col("lcp"))
        last, pairs = pairs, stash(both.withColumn("lcp", longer).select("_id", "_th", "pos", "place", "_pid", "_pth", "_ppos", "lcp"))
        release(last)
        span //= 2
    release(ordered, final, *levels)
    return pairs.select("_id", "_th", "pos", "place", "lcp")


def ranks(table: DataFrame, distinct_rows: bool = False) -> DataFrame:
    """Suffixes with the rank of their value (r1, r2) and whether they are full. On the first level values
    that occur once are left out, and all that stay are full."""
    values = table.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("c"))
    values = values.filter("c > 1") if distinct_rows else values
    # the distinct values in order; a rank is the place in that order
    ordered = stash(values.repartitionByRange(n_parts(table), "r1", "r2").sortWithinPartitions("r1", "r2").select("r1", "r2", F.monotonically_increasing_id().alias("rank")))
    out = table.join(ordered, ["r1", "r2"]).select("_id", "_th", "pos", "rank", *([F.lit(True).alias("full")] if distinct_rows else ["full"]))
    # rows that share identifier and text are one document
    out = stash(out.distinct() if distinct_rows else out)
    release(ordered)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, texts: bool = True) -> DataFrame:
    """One row a document: doc_id, n_lines (not blank), n_removed, kept_sha256 and, if asked for,
    kept_text (the lines that stay, blank ones too, with their line ends)."""
    marks = repeated_runs(docs, id_col, text_col, min_lines).groupBy("_id", "_th").agg(F.collect_set("pos").alias("_pos"))
    rows = docs.select(F.col(id_col).alias("doc_id"), order_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_th"), text_of(text_col).alias("_text"))
    rows = rows.join(marks, ["_id", "_th"], "left").select("doc_id", "_text", F.coalesce("_pos", F.expr("array()").cast("array<int>")).alias("_pos"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                off, data = text_buffers(part.column("_text"))
                s, _, begin, _, full = lines(off, data)
                first = np.searchsorted(s, off)
                pos = part.column("_pos")
                n_at = np.diff(np.asarray(pos.offsets)) if len(pos) else np.zeros(0, np.int64)
                of, at = np.repeat(np.arange(part.num_rows), n_at), np.asarray(pos.flatten())
                start, end = first[of] + at, first[of] + at + min_lines
                copy = at == WHOLE
                start[copy], end[copy] = first[of[copy]], first[of[copy] + 1]
                long_ = end - start >= min_lines
                edge = np.zeros(len(s) + 1, dtype=np.int64)
                np.add.at(edge, start[long_], 1)
                np.add.at(edge, end[long_], -1)
                gone = np.cumsum(edge)[:-1] > 0
                keep = np.ones(len(begin), dtype=bool)
                keep[full[gone]] = False
                # a line goes with its line end
                bytes_ = np.repeat(keep, np.diff(np.append(begin, len(data))))
                left = data[bytes_].tobytes()
                ends = np.concatenate([[0], np.cumsum(bytes_)])[off]
                pieces = [left[a:b] for a, b in zip(ends[:-1], ends[1:])]
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
                cols = [part.column("doc_id"), pa.array(np.diff(first)), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in pieces])]
                if texts:
                    cols.append(pa.array(pieces, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
