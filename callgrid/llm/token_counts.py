"""Token counts with overlap resynchronisation for huge documents.

A huge text is encoded in chunks that overlap. The tokenizer splits at white space before its merges
and drops it, so a run of white space is a boundary that no token, no normal form and no special string
crosses. In the overlap of two chunks, both encodings must show the same token ends at such a
boundary; the chunks are spliced there. An overlap without one is doubled, at last to the whole text.

Null counts as empty; an empty text has no tokens. Special strings inside texts are the library's
default: their own token.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.llm.common import text_of

CHUNK, OVERLAP = 1 << 16, 1 << 10
_loaded: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def stable_ends(text: str, spans: list[tuple[int, int]]) -> dict[int, int]:
    """Boundaries of an encoding: the end of each token that white space follows, with the number of
    tokens up to it."""
    return {e: i + 1 for i, (_, e) in enumerate(spans) if e < len(text) and text[e].isspace() and (i + 1 == len(spans) or spans[i + 1][0] > e)}


def count_long(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from overlapping chunks. encode(text) gives the tokens' offsets."""
    at, total, ahead = 0, 0, overlap
    while True:
        to = at + chunk
        if to + ahead >= len(text):
            return total + len(encode(text[at:]))
        here = stable_ends(text[at : to + ahead], encode(text[at : to + ahead]))
        # the next chunk starts on white space, so its own start is a boundary as well
        start = next((i for i in range(to, to + ahead) if text[i].isspace()), None)
        if start is not None:
            there = stable_ends(text[start : to + ahead], encode(text[start : to + ahead]))
            common = [e for e in there if e + start - at in here]
            if common:
                e = common[0] + start - at
                total += here[e]
                at += e
                ahead = overlap
                continue
        ahead *= 2


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit. `path` names a tokenizer file that
    every executor can read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            n = np.zeros(len(texts), dtype=np.int64)
            short = [i for i, x in enumerate(texts) if len(x) <= chunk + overlap]
            for lo in range(0, len(short), 64):
                some = short[lo : lo + 64]
                n[some] = [len(e) for e in t.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)]
            for i in set(range(len(texts))) - set(short):
                n[i] = count_long(lambda x: t.encode(x, add_special_tokens=False).offsets, texts[i], chunk, overlap)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
