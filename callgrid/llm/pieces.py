"""SentencePiece encoding and decoding with a BPE model, by suffix-array matching.

The words of a batch (cut before each run of word marks, which no piece crosses) are made unique and
concatenated. A suffix array of that text, by prefix doubling over packed bytes, gives every piece its
range of occurrences by binary search; the occurrences are the edges (position, length, piece) of the
words' lattices, laid out by position. Relaxation applies, in every word at once, the best-scored edge
that joins two neighbouring symbols, leftmost on a tie, until no edge joins any: the model's own merge
order. Characters without a piece become byte pieces. Decoding concatenates the pieces' bytes.

Null and empty texts have no pieces; a null text decodes to null. The model's word mark itself (U+2581)
reads as a space, so a text that holds it does not come back letter by letter. A single word of many
megabytes needs memory for its tables of edges: some hundred bytes a character.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrid.llm.common import carried, mix, quoted, slices, text_buffers, text_of, word_digests

MARK = np.frombuffer("▁".encode(), np.uint8)
NONE = np.int32(2**31 - 1)
LONG_WORD = 96
CACHE_WORDS, CHUNK_BYTES, SLICE_BYTES = 1_000_000, 1 << 18, 2 << 20


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every (start, length), one after another."""
    return np.arange(int(lens.sum())) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


def require(path: str) -> None:
    """A ValueError unless the model is of the kind that is encoded here: byte-pair merges with byte fallback, the
    identity as normaliser, a mark before each text and for each space, and no pieces of the user's own."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, how = model.normalizer_spec, model.trainer_spec
    plain = norm.name == "identity" and not norm.precompiled_charsmap and not norm.normalization_rule_tsv
    spaced = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not how.treat_whitespace_as_suffix
    if not (plain and spaced and how.model_type == how.BPE and how.byte_fallback):
        raise ValueError("the model normalises its texts, or is not of byte-pair merges with byte fallback")
    if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
        raise ValueError("the model has pieces of the user's own")


class Model:
    """Pieces, scores and byte pieces of a model file that ``require`` lets pass."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id = np.full(256, sp.unk_id(), dtype=np.int32)
        texts, self.ids, scores, out = [], [], [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i):
                out.append(b"")
            elif sp.is_unknown(i):
                out.append(" ⁇ ".encode())
            else:
                texts.append(piece.encode())
                self.ids.append(i)
                scores.append(sp.get_score(i))
                out.append(piece.replace("▁", " ").encode())
        self.ids = np.array(self.ids, dtype=np.int32)
        self.lens = np.array([len(t) for t in texts])
        self.chars = np.array([len(t.decode()) for t in texts])
        self.widest = int(self.chars.max())
        self.columns = -(-int(self.lens.max()) // 8)
        self.rank = np.unique(-np.array(scores), return_inverse=True)[1].astype(np.int32)
        packed = np.zeros((len(texts), self.columns * 8), dtype=np.uint8)
        for i, t in enumerate(texts):
            packed[i, : len(t)] = np.frombuffer(t, np.uint8)
        self.keys = packed.view(">u8").astype(np.uint64)
        used = np.clip(self.lens[:, None] - 8 * np.arange(self.columns), 0, 8)
        # masks of the bytes of each column that belong to a piece
        self.masks = np.array([(2**64 - 1) ^ (2 ** (64 - 8 * k) - 1) for k in range(9)], dtype=np.uint64)[used]
        self.out_off = np.concatenate([[0], np.cumsum([len(x) for x in out])])
        self.out = np.frombuffer(b"".join(out), np.uint8)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (position, piece number) at which a piece occurs."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(8 * self.columns + 8, np.uint8)])
        key = np.zeros(n + 8 * self.columns, dtype=np.uint64)
        m = len(key)
        for j in range(8):
            key |= padded[j : j + m].astype(np.uint64) << np.uint64(56 - 8 * j)
        # prefix doubling: ranks by 8 bytes, then 16, 32, ... until pieces are covered
        rank = np.unique(key[:n], return_inverse=True)[1].astype(np.uint64)
        depth = 8
        while depth < 8 * self.columns:
            ahead = np.zeros(n, dtype=np.uint64)
            ahead[: max(0, n - depth)] = rank[depth:] + np.uint64(1)
            pair = (rank << np.uint64(32)) | ahead
            order = np.argsort(pair, kind="stable")
            step = np.zeros(n, dtype=np.uint64)
            step[1:] = pair[order][1:] != pair[order][:-1]
            rank[order] = np.cumsum(step)
            depth *= 2
            if n == 0 or int(rank[order[-1]]) == n - 1:
                break
        order = np.argsort(rank, kind="stable")

        def bound(upper: bool) -> np.ndarray:
            lo, hi = np.zeros(len(self.lens), np.int64), np.full(len(self.lens), n)
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    return lo
                mid = (lo[open_] + hi[open_]) // 2
                at = order[mid]
                less = np.zeros(len(open_), dtype=bool)
                same = np.ones(len(open_), dtype=bool)
                for c in range(self.columns):
                    some = np.flatnonzero(same & (self.masks[open_, c] != 0)) if c else np.arange(len(open_))
                    if not len(some):
                        break
                    here, want = key[at[some] + 8 * c] & self.masks[open_[some], c], self.keys[open_[some], c]
                    less[some] = here < want
                    same[some] = here == want
                right = less | (same if upper else False)
                lo[open_[right]] = mid[right] + 1
                hi[open_[~right]] = mid[~right]

        lo, hi = bound(False), bound(True)
        return order[ragged(lo, hi - lo)], np.repeat(np.arange(len(self.lens)), hi - lo)

    def encode_words(self, text: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words (text[off[i]:off[i + 1]]) and their edges by word."""
        lead = np.flatnonzero((text & 0xC0) != 0x80)  # a character's first byte
        char_of = np.cumsum((text & 0xC0) != 0x80) - 1
        word_char = np.searchsorted(lead, off)
        n = len(lead)
        pos, piece = self.occurrences(text)
        ok = ((text[pos] & 0xC0) != 0x80) & (pos + self.lens[piece] <= off[np.searchsorted(off, pos, side="right")])
        pos, piece = char_of[pos[ok]], piece[ok]
        joins = np.full((n + 1, self.widest + 1), NONE, dtype=np.int32)
        joins[pos, self.chars[piece]] = self.rank[piece]
        number = np.full((n + 1, self.widest + 1), -1, dtype=np.int32)
        number[pos, self.chars[piece]] = self.ids[piece]

        size = np.diff(word_char)
        start, length = np.arange(n), np.ones(n, dtype=np.int64)
        word = np.repeat(np.arange(len(size)), size)
        done_s, done_l = [], []
        for w in np.flatnonzero(size > LONG_WORD):
            s, l_ = self._long_word(joins, int(word_char[w]), int(word_char[w + 1]))
            done_s.append(s)
            done_l.append(l_)
        keep = (size <= LONG_WORD)[word]
        start, length, word = start[keep], length[keep], word[keep]
        while len(start):
            total = length[:-1] + length[1:]
            fits = (word[1:] == word[:-1]) & (total <= self.widest)
            rank = np.full(len(start), NONE, dtype=np.int32)
            rank[:-1][fits] = joins[start[:-1][fits], total[fits]]
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            each = np.repeat(best, np.diff(np.append(heads, len(start))))
            ended = each == NONE
            if ended.any():
                done_s.append(start[ended])
                done_l.append(length[ended])
            hit = np.flatnonzero((rank == each) & ~ended)
            if not len(hit):
                break
            hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])]
            length[hit] += length[hit + 1]
            stay = ~ended
            stay[hit + 1] = False
            start, length, word = start[stay], length[stay], word[stay]
        start, length = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_s, done_l))
        order = np.argsort(start)
        start, length = start[order], length[order]
        ids = number[start, np.minimum(length, self.widest)]
        # characters without a piece: one id for each byte
        bytes_ = np.diff(np.append(lead, len(text)))
        wide = np.where(ids >= 0, 1, bytes_[start] if len(start) else 0)
        out = np.repeat(ids, wide)
        raw = np.flatnonzero(out < 0)
        unknown = ids < 0
        out[raw] = self.byte_id[text[ragged(lead[start[unknown]], wide[unknown])]]
        edges = np.concatenate([[0], np.cumsum(wide)])[np.searchsorted(start, word_char)]
        return out, edges

    def _long_word(self, joins: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The same relaxation of one long word, with a queue."""
        n = hi - lo
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and size[i] + size[j] <= self.widest and (r := int(joins[lo + i, size[i] + size[j]])) != NONE:
                heapq.heappush(queue, (r, i, size[i] + size[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, total = heapq.heappop(queue)
            j = after[i]
            if size[i] == 0 or j >= n or size[i] + size[j] != total:
                continue
            size[i], size[j], after[i] = total, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        some = np.flatnonzero(size)
        return some + lo, np.array(size)[some]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of every text's pieces, without the space that encoding put in front."""
        lens = (self.out_off[1:] - self.out_off[:-1])[ids]
        raw = self.out[ragged(self.out_off[ids], lens)]
        off = np.concatenate([[0], np.cumsum(lens)])[edges]
        head = off[:-1][np.diff(off) > 0]
        keep = np.ones(len(raw), dtype=bool)
        keep[head[raw[head] == 0x20]] = False
        return raw[keep], np.concatenate([[0], np.cumsum(keep)])[off]


class Encoder:
    """Encodes batches; words met before are kept, up to CACHE_WORDS of them."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.seen, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.from_, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __call__(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and their edges by text."""
        size = np.diff(off)
        # a mark in front of each text that is not empty, and in place of each space
        full = np.flatnonzero(size > 0)
        wide = np.where(data == 0x20, 3, 1)
        wide[off[full]] += 3
        end = np.cumsum(wide)
        text = np.empty(int(end[-1]) if len(end) else 0, dtype=np.uint8)
        text[end - 1] = data
        for at in (end[data == 0x20] - 3, (end - wide)[off[full]]):
            for j in range(3):
                text[at + j] = MARK[j]
        new_off = np.concatenate([[0], end])[off]
        mark = np.zeros(len(text) + 3, dtype=bool)
        mark[: max(0, len(text) - 2)] = (text[:-2] == MARK[0]) & (text[1:-1] == MARK[1]) & (text[2:] == MARK[2])
        first = mark[: len(text)].copy()
        first[3:] &= ~mark[: max(0, len(text) - 3)]
        first[new_off[full]] = True
        begin = np.flatnonzero(first)
        stop = np.append(begin[1:], len(text))
        # words are the same by 128 bits: sorted by the first half, and held against the second
        one, two = word_digests(text, begin, stop)
        unique, index, inverse = np.unique(one, return_index=True, return_inverse=True)
        while not np.array_equal(two[index][inverse], two):
            one = mix(one + mix(two))
            self.forget()
            unique, index, inverse = np.unique(one, return_index=True, return_inverse=True)
        if len(self.seen) > CACHE_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.seen, unique), max(0, len(self.seen) - 1))
        known = self.seen[at] == unique if len(self.seen) else np.zeros(len(unique), bool)
        if known.any() and not np.array_equal(self.second[at[known]], two[index[known]]):
            self.forget()
            known[:] = False
        fresh = np.flatnonzero(~known)
        # words with so many bytes at a time, or one: the tables of edges take their size
        reach = np.cumsum((stop - begin)[index[fresh]])
        lo = 0
        while lo < len(fresh):
            hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + CHUNK_BYTES, side="right")))
            some = index[fresh[lo:hi]]
            lo = hi
            lens = stop[some] - begin[some]
            ids, edges = self.model.encode_words(text[ragged(begin[some], lens)], np.concatenate([[0], np.cumsum(lens)]))
            self.seen, self.second = np.concatenate([self.seen, one[some]]), np.concatenate([self.second, two[some]])
            self.from_ = np.concatenate([self.from_, len(self.ids) + edges[:-1]])
            self.size = np.concatenate([self.size, np.diff(edges)])
            self.ids = np.concatenate([self.ids, ids])
        if len(fresh):
            order = np.argsort(self.seen)
            self.seen, self.second, self.from_, self.size = self.seen[order], self.second[order], self.from_[order], self.size[order]
        place = np.searchsorted(self.seen, unique)[inverse]
        lens = self.size[place]
        ids = self.ids[ragged(self.from_[place], lens)]
        edges = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(begin, new_off)]
        return ids, edges


OUTPUTS = ("ids", "n_tokens", "ids_sha256", "round_trip")


def encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns named in `keep`, then ids (array of piece numbers), n_tokens, ids_sha256 (of the
    numbers as little-endian 32 bits) and round_trip (whether decoding gives the text back)."""
    require(path)
    rows = docs.select(carried(keep, OUTPUTS).alias("_row"), text_of(text_col).alias("_text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Model(path))
        for batch in batches:
            for part in slices(batch, "_text", SLICE_BYTES):
                off, data = text_buffers(part.column("_text"))
                ids, edges = encoder(off, data)
                raw, back = encoder.model.decode(ids, edges)
                flat = np.ascontiguousarray(ids.astype("<i4"))
                view = memoryview(flat).cast("B")
                sha = [hashlib.sha256(view[4 * a : 4 * b]).hexdigest() for a, b in zip(edges[:-1], edges[1:])]
                whole = np.array_equal(off, back) and np.array_equal(raw, data)
                same = np.ones(part.num_rows, bool) if whole else np.array([np.array_equal(raw[c:d], data[a:b]) for a, b, c, d in zip(off[:-1], off[1:], back[:-1], back[1:])], dtype=bool)
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("_row"), lists, pa.array(np.diff(edges)), pa.array(sha, pa.string()), pa.array(same)], ["_row", *OUTPUTS])

    return rows.mapInArrow(run, schema).select("_row.*", *OUTPUTS)


def decode(rows: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns named in `keep`, then text: what the piece numbers stand for (null for null)."""
    require(path)
    rows = rows.select(carried(keep, ("text",)).alias("_row"), quoted(ids_col).alias("_ids"))
    schema = T.StructType([rows.schema["_row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            lists = batch.column("_ids")
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], dtype=np.int64)
            raw, off = model.decode(np.asarray(lists.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
            data = raw.tobytes()
            texts = [data[a:b].decode(errors="replace") if ok else None for a, b, ok in zip(off[:-1], off[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], ["_row", "text"])

    return rows.mapInArrow(run, schema).select("_row.*", "text")
