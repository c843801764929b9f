"""Learned operators, nearest neighbours, tokens and the mix: held-out accuracy, recall, libraries."""

import math
import re
import zlib

import numpy as np
import pytest

import public_tokenizers
from callgrid.llm import language_id, mixing, neighbours, pieces, quality, queries, token_counts

WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language_id_on_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op5_language_id(spark, SF).collect()
    assert len(got) == len(lang) and all(r["held_out"] == held_out(r["doc_id"]) for r in got)
    judged = [r for r in got if r["held_out"] and lang[r["doc_id"]] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in judged]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_of_odd_rows(odd, odd_rows, empty):
    model = language_id.fit(odd, odd["doc_id"] >= 0)
    got = language_id.predict(odd, model, odd.columns).collect()
    assert len(got) == len(odd_rows) and set(got[0].asDict()) == {*odd.columns, "lang_pred", "ambiguous"}
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and r["_text"] == "x"
    assert language_id.identified(odd, model).columns == odd.columns
    none = language_id.fit(empty, empty["doc_id"] >= 0)
    assert language_id.predict(empty, none, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(odd, none, ["doc_id"]).collect()} == {"und"}


def test_codewords_stay_apart():
    for n in (2, 4, 7, 40):
        code = language_id.codewords(n)
        assert code.shape[0] == n and min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else code.shape[1] // 4)


def test_quality_on_held_out_labels(spark):
    want = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op3_quality_ranking(spark, "/root/testdata/sf0.1").collect()}
    some = [(got[d]["score"], got[d]["predicted"], y) for d, y in want.items() if held_out(d) and d in got and y is not None]
    good, bad = np.array([s for s, _, y in some if y == 1]), np.array([s for s, _, y in some if y == 0])
    assert (good[:, None] > bad[None]).mean() > 0.85
    assert np.mean([p == y for _, p, y in some]) > 0.8
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())


def test_quality_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(3, None, 1), (None, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(odd, quality.train(odd, labels)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["score"] == pytest.approx(0.3) for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect())
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def exact_neighbours(rows, asked, k):
    out = {}
    for q, x in asked.items():
        d = sorted((float(np.sqrt(((np.array(v) - x) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = d[:k]
    return out


def test_neighbours_recall(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = exact_neighbours(rows, {i: v for i, v in rows.items() if i % 100 == 0}, 10)
    got = {}
    for r in queries.op4_nearest_neighbours(spark, SF).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    recall = np.mean([len({i for _, i in got[q].values()} & {i for _, i in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    for q, found in got.items():
        assert all(s == pytest.approx(np.linalg.norm(rows[i] - rows[q]), rel=1e-12) for s, i in found.values())
        assert [found[k] for k in sorted(found)] == sorted(found.values())


def test_few_rows_are_compared_where_vectors_have_structure():
    """Vectors of six components in 64 dimensions, and clusters: the share of rows that a query meets."""
    rng = np.random.default_rng(1)
    plane = rng.standard_normal((20000, 6)) @ rng.standard_normal((6, 64))
    clusters = rng.standard_normal((40, 64))[rng.integers(40, size=20000)] + 0.15 * rng.standard_normal((20000, 64))
    for x, most in ((plane, 0.25), (clusters, 0.1)):
        near, bits = math.ceil(10 * 2048 / len(x)) + 3, math.log2(math.sqrt(2 * math.pi * math.e) / 2)
        g = neighbours.Geometry(64, x[:2048], near, 2, round(math.log2(len(x) / 64) / bits), 2.0, 11)
        codes, asked = g.buckets(x), x[::200]
        met = np.zeros((len(asked), len(x)), bool)
        compared = 0
        for t in range(2):
            for q, visited in enumerate(g.probes(asked, t, 0.72)):
                assert len(set(visited.tolist())) == len(visited)
                hit = np.isin(codes[t], visited)
                compared += hit.sum()
                met[q] |= hit
        want = [np.argsort(((x - q) ** 2).sum(axis=1))[:11] for q in asked]
        assert compared / len(asked) / len(x) < most and np.mean([m[w].mean() for m, w in zip(met, want)]) >= 0.9


def test_queries_beyond_the_probes_are_exact(spark):
    """Where a table gives a query up, it is held against all rows, though other tables find k."""
    rng = np.random.default_rng(8)
    rows = {i: v for i, v in enumerate(rng.standard_normal((600, 16)))}
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    asked = {i: rows[i] for i in range(0, 600, 20)}
    want = exact_neighbours(rows, asked, 10)
    for most in (1, 6):
        got = {}
        for r in neighbours.nearest(table, table.filter("vec_id % 20 = 0"), most_probes=most).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["vec_id"])
        recall = {q: len({*got[q]} & {i for _, i in want[q]}) / 10 for q in want}
        assert all(len(v) == 10 for v in got.values())
        assert all(x == 1 for x in recall.values()) if most == 1 else np.mean(list(recall.values())) >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (2, [0.0, 1.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in neighbours.nearest(table, table.filter("vec_id in (0, 3, 4, 5, 9)"), k=5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, pytest.approx(math.sqrt(2)))]
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(500)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in neighbours.nearest(same, same.filter("vec_id = 100"), k=3).orderBy("rank").collect()] == [0, 1, 2]


def test_neighbours_of_repeated_rows(spark):
    """Many rows of one identifier, with one vector or with several, hide no other identifier."""
    copies = [(1, [1.0, 0.0])] * 30 + [(i, [1.0, 0.0]) for i in (2, 3, 4)] + [(i, [0.0, float(i)]) for i in range(10, 30)]
    table = spark.createDataFrame(copies, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, table.filter("vec_id in (1, 2)").distinct(), k=5, mass=1.0).collect()
    ids = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (1, 2)}
    assert ids == {1: [2, 3, 4, 10, 11], 2: [1, 3, 4, 10, 11]}
    several = [(0, [1.0, 0.0])] + [(1, [1.0, 0.001 * i]) for i in range(1, 31)] + [(i, [1.0, 0.01 * i]) for i in range(10, 16)]
    table = spark.createDataFrame(several, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, table.filter("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 10, 11, 12, 13]


def test_pieces_match_the_library(docs, odd, odd_rows):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    for df in (docs, odd):
        got = pieces.encode(df, PIECES, df.columns)
        assert got.columns == [c for c in df.columns if c != "ids"] + list(pieces.OUTPUTS)
        for r in got.collect():
            assert r["ids"] == sp.encode(r["text"] or "", num_threads=1) and r["round_trip"]
        back = pieces.decode(got, PIECES, ["doc_id"]).collect()
        assert sorted(x["text"] for x in back) == sorted(r["text"] or "" for r in df.select("text").collect())
    assert pieces.decode(odd.selectExpr("doc_id", "cast(null as array<int>) ids"), PIECES, ["doc_id"]).filter("text is null").count() == len(odd_rows)


def test_pieces_of_an_empty_table(empty):
    assert pieces.encode(empty, PIECES, ["doc_id"]).count() == 0


def test_token_counts_match_the_library(spark, docs, odd, odd_rows):
    t = token_counts.tokenizer(WORD_BPE)
    special = spark.createDataFrame([(1, "a <|endoftext|> b <|startoftext|>"), (2, "x" * 5000), (3, " ".join(["Ab"] * 900))], "doc_id long, text string")
    for df, chunk in ((docs, 1 << 16), (docs, 300), (odd, 1 << 16), (odd, 64), (special, 50)):
        want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.select("doc_id", "text").collect())
        got = token_counts.token_counts(df, WORD_BPE, chunk=chunk, overlap=16)
        assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
        assert got.filter("over_limit <> (n_tokens > 2048)").count() == 0


def water_fill(sizes, weights, total, most):
    """Targets by weight, none above `most` times its size, by filling one source after another."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] >= most * sizes[i]}
        for i in full or open_:
            out[i] = most * sizes[i] if full else level * weights[i]
        left -= sum(out[i] for i in full)
        open_ -= full or open_
    return out


def test_mix_meets_its_targets(spark, docs):
    plan = queries.op1_mix_sources(spark, SF).collect()
    again = queries.op1_mix_sources(spark, SF).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, again))
    source = {r["doc_id"]: (r["source"], len(WORD.findall(r["text"] or ""))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken, target = {}, {}, {}
    for r in plan:
        s, n = source[r["doc_id"]]
        assert r["size"] == n and r["taken"] <= 3 * n
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + n, taken.get(s, 0) + r["taken"], r["target"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))], sum(sizes.values()), 3)
    assert [target[s] for s in names] == pytest.approx(want)
    # whole documents: no choice of one more or one less comes closer than half the largest one
    most = {s: max(r["size"] for r in plan if source[r["doc_id"]][0] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 for s in names) and np.median([abs(taken[s] / target[s] - 1) for s in names]) < 0.002
    assert all(r["source_size"] == sizes[source[r["doc_id"]][0]] for r in plan)


@pytest.mark.parametrize("sizes", [[10, 1000], [0, 10], [5], [7, 7, 7], [1, 1, 1, 400, 2, 30, 0], []])
def test_targets_reshare_what_is_above(spark, sizes):
    named = spark.createDataFrame([(f"s{i:03}" if i else None, n, 1) for i, n in enumerate(sizes)], "_source string, size long, n long")
    order = list(range(1, len(sizes))) + [0][: len(sizes)]  # null last
    got = {r["_source"]: r["_target"] for r in mixing.targets(named, mixing.cycle_weights, 1.0, 3.0).collect()}
    want = water_fill([sizes[i] for i in order], [1 + i % 3 for i in range(len(order))], sum(sizes), 3)
    assert [got[f"s{i:03}" if i else None] for i in order] == pytest.approx(want)


@pytest.fixture(scope="module")
def sourced(spark):
    """40 sources of 50 documents, some of them alike but for an extra column."""
    return spark.range(2000).selectExpr("id doc_id", "repeat('w ', cast(1 + id * 7 % 23 as int)) text", "'en' lang", "concat('s', id % 40) source", "id % 3 n_chars").unionByName(spark.sql("select 5000L doc_id, 'a b' text, 'en' lang, 's1' source, x n_chars from values (1L), (2L), (2L) t(x)"))


def test_mix_takes_what_the_shards_draw(sourced, monkeypatch):
    small = {"words_per_shard": 500, "tree_columns": 7}
    one, other = ({r["doc_id"]: len(r["_places"]) for r in mixing.plan_mix(sourced, seed=s, **small).collect()} for s in (1, 2))
    assert one.keys() == other.keys() and sum(one[i] != other[i] for i in one) > 200
    for seed in (1, 2):
        rows = mixing.plan_mix(sourced, seed=seed, **small).selectExpr("_source_size", "_target", "_size * size(_places) taken", "_places").collect()
        assert len({p["shard"] for r in rows for p in r["_places"]}) > 20
        by = {}
        for r in rows:
            by[r["_target"], r["_source_size"]] = by.get((r["_target"], r["_source_size"]), 0) + r["taken"]
        assert sum(by.values()) == pytest.approx(sum(r["_source_size"] / 50 for r in rows), rel=0.05)
    # draws that are not made are documents that are not taken
    whole = mixing.draws
    monkeypatch.setattr(mixing, "draws", lambda *a: whole(*a).filter("shard % 2 = 0"))
    half = sum(len(r["_places"]) for r in mixing.plan_mix(sourced, seed=1, **small).collect())
    assert 0.3 * sum(one.values()) < half < 0.7 * sum(one.values())


def test_mix_keeps_rows_that_differ_in_other_columns(sourced):
    few = sourced.filter("source in ('s1', 's2') and doc_id >= 1900 or doc_id = 5000")
    plan = mixing.plan_mix(few, max_repeats=9.0, total_share=2.0)
    times = plan.filter("doc_id = 5000").selectExpr("sum(size(_places)) n").first()["n"]
    mixed = mixing.mix(few, max_repeats=9.0, total_share=2.0).filter("doc_id = 5000").groupBy("n_chars").count().collect()
    assert {r["n_chars"] for r in mixed} == {1, 2} and sum(r["count"] for r in mixed) == times


def test_permuted_is_a_permutation():
    for n in (1, 2, 3, 17, 1000):
        for key in (1, 99):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got) == list(range(n))
    assert (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 1)) != np.arange(1000)).mean() > 0.9


def test_shards_share_out_all_blocks():
    quotas = np.array([256, 3, 0, 700])
    runs = [mixing.shard_runs(quotas, 7, s, 5) for s in range(7)]
    assert (sum(c for c, _ in runs) == quotas).all()
    for source in range(4):
        cuts = sorted((int(o[source]), int(o[source] + c[source])) for c, o in runs if c[source])
        assert all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))


def test_mix_rows_follow_the_plan(odd, odd_rows, empty):
    plan = mixing.plan_mix(odd)
    assert plan.count() == len(odd_rows)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == plan.selectExpr("sum(size(_places)) n").first()["n"]
    assert [tuple(r) for r in mixed.collect()] == [tuple(r) for r in mixing.mix(odd).collect()]
    assert mixing.mix(empty).count() == 0
