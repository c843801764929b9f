"""The numbered queries over the test tables, thin over their operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.llm.common import crc_bucket, documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrid.llm.mixing import plan_mix

    return plan_mix(documents(spark, sf_dir)).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.size("_places")).cast("long").alias("taken")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrid.llm.exact_dedup import content_groups

    return content_groups(documents(spark, sf_dir))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from callgrid.llm.pieces import encode

    return encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from callgrid.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrid.llm.substring_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), texts=False)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrid.llm.ngram_join import similar_components

    return similar_components(documents(spark, sf_dir), n=4, percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs from one line up."""
    from callgrid.llm.line_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), min_lines=1, texts=False)


def op2_line_dedup_from_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs from two lines up: a repeated line between other neighbours stays."""
    from callgrid.llm.line_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), min_lines=2, texts=False)


def op3_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrid.llm.quality import score, train

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_bucket("doc_id") != 0)
    model = train(docs, labels)
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(crc_bucket("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrid.llm.neighbours import nearest

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrid.llm.language_id import fit, predict

    docs = documents(spark, sf_dir)
    model = fit(docs, crc_bucket("doc_id") != 0)
    found = predict(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(crc_bucket("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrid.llm.whitening import fit, whiten

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    model = fit(vectors)
    rows = whiten(vectors, model, ["vec_id"]).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(x) for x in [*model["explained"].tolist(), 0.0]]), F.col("_at") + 1)
    return rows.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(model["identity_error"]).alias("identity_error"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrid.llm.spelling import variants, vocabulary

    def spelled(doc: Column, run: Column) -> Column:
        """A run in 199 loses a letter, by its checksum with the document's identifier."""
        h = F.crc32(F.concat(doc, F.lit(":"), run))
        at = (h % F.char_length(run)).cast("int")
        return F.when(h % 199 == 0, F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))).otherwise(run)

    return variants(vocabulary(documents(spark, sf_dir), spelled=spelled))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from callgrid.llm.toxicity import score, train

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_bucket("doc_id") != 0)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(crc_bucket("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op2_line_dedup_from_two": op2_line_dedup_from_two,
    "op3_quality_ranking": op3_quality_ranking,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_language_id": op5_language_id,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_whitening": op11_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_toxicity": op13_toxicity,
}

OP6_SQL = r"""
with n as (select doc_id, coalesce(text, '') t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') norm from documents),
r as (select *, row_number() over (partition by norm order by length(t) desc, doc_id nulls last) rk, count(*) over (partition by norm) group_size from n),
k as (select norm, doc_id keep_id from r where rk = 1)
select r.doc_id, k.keep_id, r.group_size::bigint group_size, r.rk = 1 kept, sha256(r.norm) text_sha256 from r join k using (norm)
"""

OP2_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, n, ls[n] line, trim(ls[n], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) k from (select doc_id, ls, unnest(range(1, len(ls) + 1)) n from d)),
a as (select *, k <> '' and row_number() over (partition by k order by doc_id, n) > 1 removed, n = max(n) over (partition by doc_id) last from l)
select doc_id, count(case when k <> '' then 1 end)::bigint n_lines, count(case when removed then 1 end)::bigint n_removed,
  sha256(coalesce(string_agg(case when not removed then line || case when last then '' else chr(10) end end, '' order by n), '')) kept_sha256
from a group by doc_id
"""

OP2_FROM_TWO_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select doc_id, n, ls[n] line, trim(ls[n], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) k from (select doc_id, ls, unnest(range(1, len(ls) + 1)) n from d)),
s as (select *, row_number() over (partition by doc_id order by n) pos from l where k <> ''),
w as (select doc_id, pos, k, lead(k) over (partition by doc_id order by pos) k2 from s),
f as (select *, row_number() over (partition by k, k2 order by doc_id, pos) rk from w where k2 is not null),
gone as (select distinct doc_id, p pos from (select doc_id, unnest([pos, pos + 1]) p from f where rk > 1)),
a as (select l.doc_id, l.n, l.line, s.pos, gone.pos is not null removed, l.n = max(l.n) over (partition by l.doc_id) last
      from l left join s on s.doc_id = l.doc_id and s.n = l.n left join gone on gone.doc_id = s.doc_id and gone.pos = s.pos)
select doc_id, count(pos)::bigint n_lines, count(case when removed then 1 end)::bigint n_removed,
  sha256(coalesce(string_agg(case when not removed then line || case when last then '' else chr(10) end end, '' order by n), '')) kept_sha256
from a group by doc_id
"""

ORACLES = {"op2_line_dedup": OP2_SQL, "op2_line_dedup_from_two": OP2_FROM_TWO_SQL, "op6_exact_dedup": OP6_SQL}
