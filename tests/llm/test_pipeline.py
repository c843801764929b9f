"""The pipeline, stage by stage, against what the operators promise."""

import re

import pytest

import corpus_pipeline
from callgrid.llm.common import stash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, f in corpus_pipeline.STAGES:
        docs.append(stash(f(spark, docs[-1], SF)))
    return docs


def test_stage_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix", "encode"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns[: len(steps[0].columns)] == steps[0].columns


def test_language_stage_keeps_clean_documents(steps):
    clean = steps[0].filter(r"lang is not null and text rlike '\\p{L}' and n_chars > 200")
    gone = clean.join(steps[1], "doc_id", "left_anti").count()
    assert gone <= 0.01 * clean.count() and steps[1].count() <= steps[0].count()


def test_language_stage_drops_what_it_rejects(spark, steps):
    """Documents without letters or text, and halves of two languages in one, beside the table's own."""
    two = steps[0].filter("n_chars > 400 and lang is not null").groupBy("lang").agg({"text": "min"}).toDF("lang", "text").orderBy("lang").limit(2).collect()
    mixed = " ".join(x for pair in zip(two[0]["text"].split()[:60], two[1]["text"].split()[:60]) for x in pair)
    bad = [(10**9, "12 34 56 !"), (10**9 + 1, None), (10**9 + 2, " "), (10**9 + 3, "2024-01-01;;;")]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in [*bad, (10**9 + 9, mixed)]], steps[0].schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, steps[0].unionByName(more), SF).select("doc_id").collect()}
    assert not kept & {i for i, _ in bad} and len(kept) >= 0.99 * steps[0].count()


def test_exact_stage_leaves_one_of_equal_texts(steps):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in steps[2].collect()]
    before = {re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in steps[1].collect()}
    assert len(norm) == len(set(norm)) and set(norm) == before


def test_near_stage_leaves_one_of_each_component(steps):
    from test_dedup import components_brute, pairs

    want = components_brute(pairs(steps[2]), 5, 80)
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted(d for d, (_, c) in want.items() if c == d)


def test_mix_and_encode_stages(steps):
    have = {r["doc_id"] for r in steps[3].collect()}
    counts = {r["doc_id"]: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert set(counts) <= have and max(counts.values()) <= 3
    assert steps[5].count() == steps[4].count() and steps[5].filter("not round_trip").count() == 0


def test_pipeline_of_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for _, f in corpus_pipeline.STAGES:
            docs = stash(f(spark, docs, SF))
        assert docs.count() >= 0
