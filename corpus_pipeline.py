"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

1. language_id: documents without letters, or whose language stays in doubt, go.
2. exact_dedup: of texts equal but for white space, the longest (then the smallest doc_id) stays.
3. near_dedup: of each component of sets of five-word shingles that are 80 % similar, the smallest doc_id stays.
4. mix: sources are brought to target shares (weights 1, 2, 3 in turn, at most 3 times each document),
   so documents of sources above their share are dropped and others repeat.
5. encode: piece numbers of every text, with a round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.llm import exact_dedup, language_id, mixing, ngram_join, pieces
from callgrid.llm.common import documents, stash
from callgrid.session import ship


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.identified(docs, language_id.fit(docs, F.lit(True)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), docs.columns)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mix", mix_stage), ("encode", encode_stage)]

#: No SQL expresses the learned first stage, the seeded mix or the piece numbers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
