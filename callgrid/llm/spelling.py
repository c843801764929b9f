"""Spelling variants by full neighbourhood generation.

Words are maximal runs of letters, counted over whole texts; those long and common enough are the
vocabulary. Two words are near if one inserted, deleted or replaced code point tells them apart. Every
word emits all its distinct deletions, replacements and insertions over the alphabet that the vocabulary
shows, as rolling hashes. A bitmap of the vocabulary's hashes, at most MOST_BITS, stops most strings that
are no words before they are shuffled; the rest is hash-joined to the vocabulary on the hash, and the
emitted string itself is built and compared with the word it met. No distance is computed. Beyond
MOST_BITS / 16 words the bitmap lets more through, and the join stays exact.

A word's form is its commonest near word (ties: the smallest in code-point order) if that is at least
`ratio` times as common; its root is where the forms lead in the end, found by doubling pointers. Counts
grow along the forms, so there are no rings.

Null and empty texts have no words; repeated rows count each time; a table without words gives no rows.
A word may be as long as its text: candidates are numbers until they have met a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import mix, n_parts, powers, release, signed, stash

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_BITS, PROBES, AT_ONCE = 1 << 28, 4, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = np.uint64(pow(_BASE, -1, 2**64))
DELETED, REPLACED, INSERTED = 0, 1, 2


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, spelled: Callable[[Column, Column], Column] | None = None, letters: str = LETTERS) -> DataFrame:
    """word and n of all words of so many code points and occurrences. spelled: what stands for an
    occurrence, from the document's identifier (as text; a null one is empty) and the lower-cased word;
    it must not be longer than the word."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(letters), F.lit(0))).alias("_run"))
    runs = runs.filter(F.char_length("_run") >= least_length).withColumn("_run", F.translate("_run", UPPER, LOWER))
    if spelled is not None:
        runs = runs.select(spelled(F.col("_id"), F.col("_run")).alias("_run")).filter(F.char_length("_run") >= least_length)
    return runs.groupBy(F.col("_run").alias("word")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins (one more entry than words)."""
    each = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    return each, np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(words), dtype=np.int64))])


def finished(h: np.ndarray, length: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + np.uint64((length * 0xD6E8FEB86659FD93) % 2**64))


def by_length(each: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and the code points of words of one length, so many code points at once or one word."""
    size = np.diff(at)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        step = max(1, most // max(1, int(length)))
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            yield some, each[at[some][:, None] + np.arange(length)].astype(np.uint64)


def hashes(words: pa.Array) -> np.ndarray:
    each, at = points(words)
    out = np.zeros(len(words), np.uint64)
    for rows, w in by_length(each, at, AT_ONCE):
        with np.errstate(over="ignore"):
            out[rows] = finished((w * powers(_BASE, w.shape[1] + 2)[0][: w.shape[1]]).sum(axis=1, dtype=np.uint64), w.shape[1])
    return out


def neighbourhood(w: np.ndarray, alphabet: np.ndarray, positions: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """All distinct edits of words of one length: hashes, kind, and the word's row, the place and the number
    of the letter of each; so many places at once."""
    m, length = w.shape
    p = powers(_BASE, length + 2)[0]
    with np.errstate(over="ignore"):
        before = np.zeros((m, length + 1), np.uint64)
        np.cumsum(w * p[:length], axis=1, out=before[:, 1:])
        total = before[:, -1:]
        for lo in range(0, length + 1, positions):
            at = np.arange(lo, min(lo + positions, length + 1))
            inner = at[at < length]
            if len(inner):
                # of a run of one letter, the first goes
                new = w[:, inner] != w[:, np.maximum(inner - 1, 0)]
                new[:, inner == 0] = True
                row, i = np.nonzero(new)
                h = before[row, inner[i]] + (total[row, 0] - before[row, inner[i] + 1]) * _BACK
                yield finished(h, length - 1), DELETED, row, inner[i], np.zeros(len(row), np.int64)
                row, i, a = np.nonzero(w[:, inner, None] != alphabet)
                h = total[row, 0] + (alphabet[a] - w[row, inner[i]]) * p[inner[i]]
                yield finished(h, length), REPLACED, row, inner[i], a
            # next to its like, a letter comes first
            fine = np.ones((m, len(at), len(alphabet)), bool)
            later = at > 0
            fine[:, later] = w[:, at[later] - 1, None] != alphabet
            row, i, a = np.nonzero(fine)
            h = before[row, at[i]] + alphabet[a] * p[at[i]] + (total[row, 0] - before[row, at[i]]) * np.uint64(_BASE)
            yield finished(h, length + 1), INSERTED, row, at[i], a


def probed(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Which bit of the bitmap a hash has at a probe."""
    with np.errstate(over="ignore"):
        return mix(h + np.uint64(probe)) & np.uint64(bits - 1)


def near_words(vocab: DataFrame, seen: int, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs a, b (identifiers) of near words, both ways. vocab: a stashed table of id, word; seen: its rows."""
    bits = min(most_bits, 1 << max(16, (16 * seen - 1).bit_length()))
    letters = vocab.select(F.explode(F.split("word", "")).alias("c")).distinct().filter("c <> ''")
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), dtype=np.uint64)  # no more than there are letters

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(signed(hashes(batch.column("word"))))], ["id", "h"])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashes(batch.column("word"))
            bit = np.unique(np.concatenate([probed(h, i, bits) for i in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int64)), pa.array(signed(np.uint64(1) << (bit & np.uint64(63))))], ["at", "bit"])

    filled = np.zeros(bits // 64, np.uint64)
    got = vocab.select("word").mapInArrow(marks, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()  # bits / 64 rows at most
    filled[np.asarray(got.column("at"))] = np.asarray(got.column("bit")).view(np.uint64)
    shared = vocab.sparkSession.sparkContext.broadcast(filled)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        step = max(1, AT_ONCE // max(1, len(alphabet)))
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for rows, w in by_length(*points(batch.column("word")), step):
                for h, kind, row, place, letter in neighbourhood(w, alphabet, step):
                    left = np.arange(len(h))
                    for i in range(PROBES):
                        bit = probed(h[left], i, bits)
                        left = left[(bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1]
                    n = len(left)
                    if n:
                        point = alphabet[letter[left]] if kind != DELETED else np.zeros(n, np.uint64)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[row[left]]]), pa.array(signed(h[left])), pa.array(np.full(n, kind, np.int32)), pa.array(place[left].astype(np.int32)), pa.array(point.astype(np.int32))], ["a", "h", "kind", "place", "point"])

    own = vocab.select("id", "word")
    candidates = own.repartition(n_parts(vocab), "id").mapInArrow(emitted, "a long, h long, kind int, place int, point int")
    met = candidates.join(own.mapInArrow(named, "id long, h long").withColumnRenamed("id", "b"), "h").drop("h")
    met = met.join(own.select(F.col("id").alias("a"), F.col("word").alias("_a")), "a").join(own.select(F.col("id").alias("b"), F.col("word").alias("_b")), "b")
    letter = F.when(F.col("kind") == DELETED, "").otherwise(F.decode(F.unhex(F.lpad(F.hex("point"), 8, "0")), "UTF-32"))
    rest = F.col("place") + F.when(F.col("kind") == INSERTED, 1).otherwise(2)
    string = F.concat(F.substring("_a", F.lit(1), F.col("place")), letter, F.substr("_a", rest))
    return met.filter(string == F.col("_b")).select("a", "b")


def variants(words: DataFrame, ratio: int = 5, most_bits: int = MOST_BITS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word. words: word and n, each word once."""
    vocab = stash(words.select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("long").alias("n")))
    pairs = near_words(vocab, vocab.count(), most_bits)
    pairs = pairs.join(vocab.select(F.col("id").alias("b"), F.col("word").alias("_b"), F.col("n").alias("_n")), "b")
    best = pairs.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("less"), F.col("_b").alias("word"), F.col("b").alias("id"))).alias("best"))
    joined = vocab.join(best, "id", "left").withColumn("_common", -F.col("best.less") >= ratio * F.col("n"))
    form = lambda c: F.when(F.col("_common"), c)
    known = stash(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form(F.col("best.word")).alias("form"), form(F.col("best.id")).alias("to"), form(-F.col("best.less")).alias("form_n")))
    ends = roots(known.filter("to is not null").select("id", "to"))
    ends = ends.join(vocab.select(F.col("id").alias("to"), F.col("word").alias("root")), "to").select("id", "root")
    return known.join(ends, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """id and to, the end of the way that begins with the link from id. links: id, to; an id once, no rings."""
    now = stash(links)
    while True:
        on = now.select(F.col("id").alias("to"), F.col("to").alias("next"))
        further = stash(now.join(on, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        release(now)
        now = further.drop("moved")
        now._stash = further._stash
        if further.filter("moved").isEmpty():
            return now
