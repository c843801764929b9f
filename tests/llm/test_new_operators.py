"""Whitening, spelling variants and toxicity: numpy, brute force, held-out accuracy."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from callgrid.llm import queries, spelling, toxicity, whitening
from callgrid.llm.common import text_buffers

SF = "/root/testdata/sf0.01"


def whitened_by_numpy(rows, k=4):
    fine = [(i, np.array(v, float)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [(i, [int(c) for c in np.floor(256 * v)]) for i, v in fine]
    distinct = np.array(sorted({tuple(v) for _, v in x}))
    n, total = len(distinct), [int(s) for s in distinct.sum(axis=0)]
    c = distinct - np.array(total) / n
    values, directions = np.linalg.eigh(c.T @ c / n)
    values, directions = values[::-1], directions[:, ::-1]
    return n, values, {(i, j + 1): ((np.array(v) - np.array(total) / n) @ directions[:, j] / np.sqrt(values[j]), sum((n * a - s) ** 2 for a, s in zip(v, total))) for i, v in x for j in range(k)}


def test_whitening_equals_numpy(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    n, values, want = whitened_by_numpy(rows)
    got = {(r["vec_id"], r["component"]): r for r in queries.op11_whitening(spark, SF).collect()}
    assert set(got) == set(want)
    sign = {j: np.sign(got[0, j]["whitened"] * want[0, j][0]) for j in range(1, 5)}
    for (i, j), (w, deviation) in want.items():
        r = got[i, j]
        assert r["n"] == n and r["deviation"] == deviation and r["whitened"] == pytest.approx(sign[j] * w, abs=1e-9)
        assert r["explained"] == pytest.approx(values[j - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_few_directions_need_no_wider_basis(spark):
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((3000, 3)) * [9, 5, 2]) @ np.linalg.qr(rng.standard_normal((40, 3)))[0].T + 0.01 * rng.standard_normal((3000, 40))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    model = whitening.fit(table, components=3)
    n, values, _ = whitened_by_numpy(list(enumerate(rows)), 3)
    assert model["n"] == n and model["values"] == pytest.approx(values[:3], rel=1e-9) and model["identity_error"] < 1e-9
    assert not whitening.fit(table, components=3, tolerance=1e-9, powers=6)["widened"]
    forced = whitening.fit(table, components=3, powers=0, tolerance=0.0)
    assert forced["widened"] and forced["values"] == pytest.approx(values[:3], rel=1e-9)


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, [-1.0, 0.25, 0.0]), (3, None), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [None, 1.0, 1.0]), (7, []), (8, [1.0]), (None, [0.5, 3.0, -2.0]), (2, [-1.0, 0.25, 0.0]), (9, [0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, deviation int, `a.b` string")
    model = whitening.fit(table)
    out = whitening.whiten(table, model, table.columns)
    assert out.columns == ["vec_id", "embedding", "a.b", "deviation", "whitened"]
    got = sorted((r["vec_id"] if r["vec_id"] is not None else 99) for r in out.collect())
    assert got == [0, 1, 2, 2, 9, 99] and model["n"] == 4 and all(len(r["whitened"]) == 3 for r in out.collect())
    same = spark.createDataFrame([(i, [3.0, 4.0]) for i in range(20)], "vec_id long, embedding array<double>")
    flat = whitening.fit(same)
    assert flat["n"] == 1 and {(r["deviation"], tuple(r["whitened"])) for r in whitening.whiten(same, flat, ["vec_id"]).collect()} == {(0, (None, None))}
    assert flat["explained"].tolist() == [0, 0] and flat["identity_error"] == 0
    none = whitening.fit(table.limit(0))
    assert whitening.whiten(table, none, ["vec_id"]).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    out = whitening.whiten(huge, whitening.fit(huge), ["vec_id"]).collect()
    assert {r["vec_id"]: r["deviation"] for r in out} == {0: None, 1: None, 2: None or out[2]["deviation"]} and all(np.isfinite(r["whitened"][0]) for r in out)
    with pytest.raises(ValueError, match="more than 2"):
        whitening.fit(table, most=2)


def edits(word, alphabet):
    for i in range(len(word) + 1):
        if i < len(word):
            yield word[:i] + word[i + 1 :]
        for a in alphabet:
            yield word[:i] + a + word[i:]
            if i < len(word) and a != word[i]:
                yield word[:i] + a + word[i + 1 :]


def variants_by_hand(n, ratio=5):
    alphabet, out = sorted({c for w in n for c in w}), {}
    near = {w: {e for e in edits(w, alphabet) if e in n and e != w} for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-n[x], x)) if some else None
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def counted(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def as_dict(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_variants_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = as_dict(queries.op12_spelling_variants(spark, "/root/testdata/sf0.001"))
    assert got == variants_by_hand(counted(docs)) and any(v[0] for v in got.values())


def test_neighbourhood_is_whole_and_distinct():
    alphabet = np.array(sorted(map(ord, "abcé")), np.uint64)
    for word in ("aabba", "éé", "a", "abcabcabc"):
        w = np.array([[ord(c) for c in word]], np.uint64)
        h = np.concatenate([x[0] for x in spelling.neighbourhood(w, alphabet, 3)])
        want = set(edits(word, "abcé")) - {word}
        assert len(h) == len(want) and set(h.tolist()) == set(spelling.hashes(pa.array(sorted(want))).tolist())


def test_spelling_variants_of_chains_ties_and_long_words(spark):
    long_ = "".join(random.Random(3).choice("abcdefgh") for _ in range(3000))
    n = {"colour": 1000, "color": 40, "colo": 8, "colourr": 200, "cooour": 200, "tie": 50, "tia": 50, "tib": 10, long_: 30, long_ + "x": 6, long_[:1500] + long_[1501:]: 5, "straße": 25, "strase": 5, "lone": 9, "xn": 25, "xm": 5, "xmm": 1, "Ωmega": 50, "omega": 10, "a\U0001f600b": 9, "ab": 1}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    want = variants_by_hand(n)
    assert as_dict(spelling.variants(table)) == want and want["xmm"][1] == "xn" and want["tib"][0] == "tia"
    assert as_dict(spelling.variants(table, most_bits=64)) == want  # a full bitmap: the join alone decides
    assert as_dict(spelling.variants(table.limit(0))) == {}


def test_vocabulary_of_odd_rows(spark, odd, odd_rows, empty):
    want = Counter()
    for r in odd_rows:
        want.update("".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall(r"[A-Za-zÀ-ÿ]+", r[1] or ""))
    got = {r["word"]: r["n"] for r in spelling.vocabulary(odd, least_length=3, least_count=2).collect()}
    assert got == {w: k for w, k in want.items() if len(w) >= 3 and k >= 2}
    assert spelling.vocabulary(empty).count() == 0 and as_dict(spelling.variants(spelling.vocabulary(empty))) == {}


def test_toxicity_on_held_out_labels(spark):
    want = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op13_toxicity(spark, "/root/testdata/sf0.1").collect()}
    some = [(got[d]["predicted"], y) for d, y in want.items() if zlib.crc32(str(d).encode()) % 5 == 0 and d in got]
    assert np.mean([p == y for p, y in some]) > 0.97
    assert np.mean([p for p, y in some if y == 1]) > 0.8 and np.mean([p for p, y in some if y == 0]) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_pairs_of_terms_count(spark):
    """A word is toxic beside one word and harmless beside another: no additive weights tell."""
    rng, rows = random.Random(7), []
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        some = [f"filler{rng.randrange(60)}" for _ in range(12)] + ["wretch" if insult else "friend", "neighbours" if group else "villain"]
        rng.shuffle(some)
        rows.append((i, " ".join(some), int(insult == group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.train(docs.drop("toxic"), docs.filter("doc_id < 1000").drop("text"), least_chi=0.0)
    right = lambda m: np.mean([(r["score"] >= 0.5) == rows[r["doc_id"]][2] for r in toxicity.score(docs.select("doc_id", "text").filter("doc_id >= 1000"), m).collect()])
    assert right(machine) > 0.95
    off, data = text_buffers(pa.array([t for _, t, _ in rows[:1000]]))
    linear = toxicity.Machine(machine.known, 0.0, len(machine.w))
    linear.v[:] = 0  # from nought the vectors don't move
    linear.fit(*toxicity.inputs(off, data, machine.known), np.array([y for _, _, y in rows[:1000]], float))
    assert right(linear) < 0.7


def test_toxicity_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(3, None, 1), (None, 1, 0), (999, 1, 1), (2, 0, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.score(odd, toxicity.train(odd, labels)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {round(r["score"], 9) for r in toxicity.score(odd, toxicity.train(odd, labels.limit(0))).collect()} == {0}
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0
    whole = toxicity.train(odd, labels, least_chi=0.0, least_rows=1)
    assert len(toxicity.score(odd, whole).collect()) == len(odd_rows)


def test_models_of_another_kind_are_refused(spark, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    import public_tokenizers
    from callgrid.llm import pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces.require(path)

    def changed(change):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        change(model)
        (tmp_path / "m.model").write_bytes(model.SerializeToString())
        return str(tmp_path / "m.model")

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for change in (lambda m: setattr(m.normalizer_spec, "name", "nmt_nfkc"), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.trainer_spec, "byte_fallback", False), lambda m: setattr(m.pieces[500], "type", 4)):
        with pytest.raises(ValueError, match="model"):
            pieces.encode(docs, changed(change), ["doc_id"])
