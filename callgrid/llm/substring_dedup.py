"""Substring dedup by seed and extend.

Words are hashed; of the k-word grams in each window of `length` words the smallest hash, rightmost on
a tie, is the window's anchor (winnowing), so equal windows share an anchor at the same place. Documents
meet on anchors that occur twice or more. Each anchor occurrence is extended both ways over all windows
that it anchors: occurrences with equal extensions are copies of the first of them; where extensions
differ, the first of each kind is compared window by window. Words count as equal by 128 bits of their
own, extensions and windows by two unlike 64-bit hashes of these; no text is sent to be compared. What is covered by a window that starts
earlier elsewhere (smaller identifier, or earlier in the same document) makes up the maximal repeats,
and is removed.

A document without words, null or empty, loses nothing. A null identifier comes after all others. Rows
that share identifier and text are one document; rows that share only the identifier are ordered by a
hash of the text. Hot anchors never meet pairwise: their occurrences are reduced by partial minima.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import grams, word_digests, mix, order_id, range_hash, signed, slices, stash, text_buffers, text_of, tree_hash, words

LENGTH, GRAM = 20, 6


def rightmost_min(v: np.ndarray, width: int) -> np.ndarray:
    """For each i, the index of the smallest of v[i : i + width], rightmost on a tie."""
    n = len(v) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    val, at, span = v, np.arange(len(v)), 1
    while span < width:
        step = min(span, width - span)
        m = len(val) - step
        right = val[step:] <= val[:m]
        val, at = np.where(right, val[step:], val[:m]), np.where(right, at[step:], at[:m])
        span += step
    return at[:n]


def anchored_runs(first_word: np.ndarray, wh: np.ndarray, other: np.ndarray, length: int, k: int):
    """Runs of windows with one anchor: text number, first window, number of windows, anchor, anchor
    hash, and two hashes of the whole stretch."""
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64))
    n = len(wh) - length + 1
    if n <= 0:
        return nothing
    g = grams(wh, k)
    anchor = rightmost_min(g, length - k + 1)[:n]
    doc = np.searchsorted(first_word, np.arange(n), side="right") - 1
    ok = np.arange(n) + length <= first_word[doc + 1]
    i = np.flatnonzero(ok)
    if not len(i):
        return nothing
    d, a = doc[i], anchor[i]
    new = np.empty(len(i), dtype=bool)
    new[0] = True
    new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1])
    s = np.flatnonzero(new)
    count = np.diff(np.append(s, len(i)))
    w0, a0 = i[s], a[s]
    with np.errstate(over="ignore"):
        span = mix(range_hash(wh, w0, w0 + count + length - 1) + (a0 - w0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    return d[s], w0, count, a0, g[a0], span, tree_hash(other, w0, count + length - 1)


def word_hashes(part: pa.RecordBatch, col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every word, and the number of each text's first word."""
    off, data = text_buffers(part.column(col))
    starts, ends, first = words(off, data)
    return *word_digests(data, starts, ends), first


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _id, _th, _text. A text's hash tells rows of one identifier apart."""
    return docs.select(F.col(id_col).alias("doc_id"), order_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_th"), text_of(text_col).alias("_text"))


def repeats(keyed: DataFrame, length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """Stretches that occur earlier: _id, _th, s, e (words from s to before e); they may overlap."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                wh, other, first = word_hashes(part, "_text")
                d, w0, n, _, h, span, second = anchored_runs(first, wh, other, length, k)
                take = pa.array(d)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(signed(span)), pa.array(signed(second)), part.column("_id").take(take), part.column("_th").take(take), pa.array((w0 - first[d]).astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "span", "second", "_id", "_th", "pos", "n"])

    found = keyed.select("_id", "_th", "_text").mapInArrow(anchors, "h long, span long, second long, _id long, _th long, pos int, n int")
    shared = found.groupBy("h").agg(F.min("span").alias("lo"), F.max("span").alias("hi"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", (F.col("lo") != F.col("hi")).alias("many"))
    # from a table of its own, so that a join with a hot anchor can be cut
    seeds = stash(found.join(stash(shared), "h"))
    place = F.struct("_id", "_th", "pos")
    # the span's hashes cover anchor and length, so they are the only key, and its first has the length
    # a table of its own too: the join with it deals both sides out anew, so that a hot stretch can be cut
    firsts = stash(seeds.groupBy("span", "second").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.max("many").alias("many")))
    copies = seeds.drop("h", "n", "many").join(firsts.drop("many"), ["span", "second"]).filter(place > F.col("first")).select("_id", "_th", F.col("pos").alias("s"), (F.col("pos") + F.col("n") + length - 1).alias("e"))

    # where one anchor has several extensions, the first of each is compared window by window
    kinds = firsts.filter("many").select("first.*", "n").groupBy("_id", "_th").agg(F.collect_list(F.struct("pos", "n")).alias("at"))
    # with doc_id, so that these rows are dealt out once for this join and the caller's
    at_text = keyed.join(kinds, ["_id", "_th"]).select("doc_id", "_id", "_th", "_text", F.col("at.pos").alias("_pos"), F.col("at.n").alias("_n"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                wh, other, first = word_hashes(part, "_text")
                d, w0, n, *_ = anchored_runs(first, wh, other, length, k)
                lists = part.column("_pos")
                docs_of = np.repeat(np.arange(part.num_rows), pc_lengths(lists))
                wanted = first[docs_of] + np.asarray(lists.flatten())
                run = np.flatnonzero(np.isin(w0, wanted))
                each = np.repeat(run, n[run])
                w = w0[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[run]) - n[run], n[run])
                take = pa.array(d[each])
                yield pa.RecordBatch.from_arrays([pa.array(signed(range_hash(wh, w, w + length))), pa.array(signed(tree_hash(other, w, np.full(len(w), length)))), part.column("_id").take(take), part.column("_th").take(take), pa.array((w - first[d[each]]).astype(np.int32))], ["w", "second", "_id", "_th", "pos"])

    each = at_text.mapInArrow(windows, "w long, second long, _id long, _th long, pos int")
    earliest = each.groupBy("w", "second").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    later = each.join(earliest, ["w", "second"]).filter(place > F.col("first")).select("_id", "_th", F.col("pos").alias("s"), (F.col("pos") + length).alias("e"))
    return copies.unionByName(later)


def pc_lengths(lists: pa.Array) -> np.ndarray:
    return np.diff(np.asarray(lists.offsets)) if len(lists) else np.zeros(0, np.int64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM, texts: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (the
    kept words joined by one space)."""
    keyed = keyed_texts(docs, id_col, text_col)
    marks = repeats(keyed, length, k).groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "e")).alias("m"))
    rows = keyed.join(marks, ["_id", "_th"], "left").select("doc_id", "_text", F.coalesce(F.col("m.s"), F.expr("array()").cast("array<int>")).alias("_s"), F.coalesce(F.col("m.e"), F.expr("array()").cast("array<int>")).alias("_e"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                off, data = text_buffers(part.column("_text"))
                starts, ends, first = words(off, data)
                edge = np.zeros(len(starts) + 1, dtype=np.int32)
                of = np.repeat(np.arange(part.num_rows), pc_lengths(part.column("_s")))
                begin, end = (first[of] + np.asarray(part.column(c).flatten()) for c in ("_s", "_e"))
                own = end <= first[of + 1]  # no mark reaches beyond its text
                np.add.at(edge, begin[own], 1)
                np.add.at(edge, end[own], -1)
                gone = np.cumsum(edge)[:-1] > 0
                # kept words joined by one space: each keeps one byte of white space behind it
                keep = np.flatnonzero(~gone)
                lens = ends[keep] - starts[keep]
                out_off = np.concatenate([[0], np.cumsum(lens + 1)])
                joined = np.full(out_off[-1], 0x20, dtype=np.uint8)
                src = np.repeat(starts[keep] - out_off[:-1], lens) + (inside := within(lens, out_off))
                joined[inside] = data[src]
                kept_first = np.searchsorted(keep, first)
                raw, n = joined.tobytes(), np.diff(first)
                pieces = [raw[out_off[a] : max(out_off[a], out_off[b] - 1)] for a, b in zip(kept_first[:-1], kept_first[1:])]
                cols = [part.column("doc_id"), pa.array(n), pa.array(n - np.diff(kept_first)), pa.array([hashlib.sha256(x).hexdigest() for x in pieces])]
                if texts:
                    cols.append(pa.array(pieces, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)


def within(lens: np.ndarray, out_off: np.ndarray) -> np.ndarray:
    """Positions of the words' bytes in the joined text."""
    return np.arange(int(lens.sum())) + np.repeat(out_off[:-1] - (np.cumsum(lens) - lens), lens)
