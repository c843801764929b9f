"""Exact dedup, line dedup, substring dedup and the n-gram join, against brute force and SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from callgrid.llm import exact_dedup, line_dedup, ngram_join, queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def key(doc_id):
    return LAST if doc_id is None else doc_id


def by_sql(sql, rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [r[:2] for r in rows])
    return sorted(con.execute(f"select * from ({sql}) order by all").fetchall(), key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_exact_dedup_matches_brute_force(odd, odd_rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in odd_rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key(doc_id)))
    got = exact_dedup.content_groups(odd).collect()
    assert len(got) == len(odd_rows)
    norm = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[1], len(v)) for k, v in groups.items()}
    assert all((key(r["keep_id"]), r["group_size"]) == norm[r["text_sha256"]] for r in got)
    assert sorted(r["text_sha256"] for r in got if r["kept"]) == sorted(norm)


def test_exact_dedup_keeps_all_columns(odd, odd_rows):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in odd_rows})
    assert all(r["_id"] == 7 and r["a.b"] == 5 for r in rows)


def test_sql_oracles_on_documents(spark, docs):
    rows = pairs(docs)
    got = exact_dedup.content_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == by_sql(queries.OP6_SQL, rows)
    for least, sql in ((1, queries.OP2_SQL), (2, queries.OP2_FROM_TWO_SQL)):
        got = line_dedup.remove_repeats(docs, min_lines=least, texts=False)
        assert sorted(map(tuple, got.collect()), key=str) == by_sql(sql, rows)


def line_brute(rows, least):
    """Removed lines of each (id, text): those in a run of `least` lines that starts earlier."""
    seqs = {}
    for doc_id, text, *_ in rows:
        seqs[(key(doc_id), text or "")] = [k for x in (text or "").split("\n") if (k := x.strip(" \t\n\x0b\x0c\r"))]
    seen, gone = set(), defaultdict(set)
    for doc, lines in sorted(seqs.items()):
        for i in range(len(lines) - least + 1):
            run = tuple(lines[i : i + least])
            if run in seen:
                gone[doc].update(range(i, i + least))
            seen.add(run)
    return {doc: (len(lines), len(gone[doc])) for doc, lines in seqs.items()}


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_dedup_matches_brute_force(spark, docs, odd, odd_rows, least):
    rows = pairs(docs)
    want = line_brute(rows, least)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.remove_repeats(docs, min_lines=least).collect()}
    assert got == {doc: v for (doc, _), v in want.items()}


def test_line_dedup_removes_all_later_copies(spark, docs):
    want = line_brute(pairs(docs), 1)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in queries.op2_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {doc: v for (doc, _), v in want.items()}
    assert sum(v[1] for v in got.values()) > sum(v[1] for v in line_brute(pairs(docs), 2).values())


@pytest.fixture(scope="module")
def runs_of_lines(spark):
    """Runs of 1 to 40 lines that repeat among lines of their own, with shared beginnings and ends."""
    rng = random.Random(8)
    shared = [f"line {i}" for i in range(40)]
    rows = []
    for i, n in enumerate([1, 2, 3, 5, 8, 13, 21, 34, 40, 40, 7, 3, 3, 2]):
        at = rng.randrange(41 - n)
        rows.append((i, "\n".join([f"own {i}", *shared[at : at + n], f"end {i}", *shared[:n], "line 3"])))
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("least", [1, 3, 4, 7, 40, 41])
def test_line_dedup_of_long_runs(runs_of_lines, least):
    df, rows = runs_of_lines
    want = {doc: v for (doc, _), v in line_brute(rows, least).items()}
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.remove_repeats(df, min_lines=least).collect()} == want


def test_suffix_array_gives_longest_common_prefixes(runs_of_lines):
    """Neighbours' common prefixes, over repeated lines, are the most that a suffix has with any other."""
    df, rows = runs_of_lines
    lines = {i: t.split("\n") for i, t in rows}
    count = Counter(x for ls in lines.values() for x in ls)
    suffixes = {}
    for i, ls in lines.items():
        for p in range(len(ls)):
            end = next((q for q in range(p, len(ls)) if count[ls[q]] == 1), len(ls))
            if end > p:
                suffixes[i, p] = ls[p:end]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    got = {}
    keyed = df.selectExpr("doc_id _id", "0L _th", "posexplode(split(text, '\n')) as (pos, line)").selectExpr("_id", "_th", "pos", "xxhash64(line) r1", "0L r2")
    array = sorted(line_dedup.suffix_array(keyed).collect(), key=lambda r: r["place"])
    assert {(r["_id"], r["pos"]) for r in array} == set(suffixes) and [r["place"] for r in array] == list(range(len(array)))
    for r, after in zip(array, [*array[1:], None]):
        got[r["_id"], r["pos"]] = max(r["lcp"], after["lcp"] if after else 0)
    assert got == {s: max(common(x, y) for t, y in suffixes.items() if t != s) for s, x in suffixes.items()}


def test_line_dedup_of_odd_rows(odd, odd_rows):
    got = line_dedup.remove_repeats(odd, min_lines=2).collect()
    assert len(got) == len(odd_rows)
    fourteen = next(r for r in got if r["doc_id"] == 14)
    assert (fourteen["n_lines"], fourteen["n_removed"], fourteen["kept_text"]) == (4, 2, "same line\nnext line\n\n")
    assert next(r for r in got if r["doc_id"] == 15)["kept_text"] == ""


def substring_brute(rows, length):
    """n_words, n_removed, digest by (id, text); rows that share both are one document."""
    docs = sorted({(key(d), t or "") for d, t, *_ in rows})
    seen, out = set(), {}
    for doc in docs:
        w = WORD.findall(doc[1])
        gone = set()
        for i in range(len(w) - length + 1):
            run = tuple(w[i : i + length])
            if run in seen:
                gone.update(range(i, i + length))
            seen.add(run)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("length,k", [(20, 6), (8, 3)])
def test_substring_dedup_matches_brute_force(docs, odd, odd_rows, length, k):
    rows = pairs(docs)
    want = {d: v for (d, _), v in substring_brute(rows, length).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs, length=length, k=k).collect()}
    assert got == want and any(v[1] for v in want.values())
    single = [r for r in odd_rows if r[0] is not None]
    want = {d: v for (d, _), v in substring_brute(single, length).items()}
    got = substring_dedup.remove_repeats(odd.filter("doc_id is not null"), length=length, k=k).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == want and len(got) == len(single)
    assert substring_dedup.remove_repeats(odd, length=length, k=k).count() == len(odd_rows)


def shingles(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components_brute(rows, n, percent):
    """n_shingles and component by identifier, by comparing all pairs that share a shingle."""
    sets = {key(d): shingles(t, n) for d, t, *_ in rows}
    at, parent = defaultdict(set), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            at[x].add(d)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets.items():
        for b in {b for x in s for b in at[x] if b > a}:
            both = len(s & sets[b])
            if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 60)])
def test_ngram_join_matches_brute_force(docs, odd, odd_rows, n, percent):
    want = components_brute(pairs(docs), n, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_components(docs, n=n, percent=percent).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    single = [r for r in odd_rows if r[0] is not None]
    want = components_brute(single, n, percent)
    got = ngram_join.similar_components(odd.filter("doc_id is not null"), n=n, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(single)


def test_ngram_join_links_chains_and_large_groups(spark):
    """A chain in which only neighbours are similar, and many distinct near copies of one text."""
    stem = [f"s{i}" for i in range(200)]
    chain = [" ".join(f"c{j}" for j in range(i * 8, i * 8 + 200)) for i in range(60)]
    group = [" ".join([*stem[:i], f"own{i}", *stem[i + 1 :]]) for i in range(200)]
    rows = [(i, t) for i, t in enumerate(chain + group)]
    want = components_brute(rows, 4, 85)
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_ngram_join_of_null_identifiers(odd, odd_rows):
    assert ngram_join.similar_components(odd).count() == len(odd_rows)
    left = ngram_join.one_of_each(odd)
    assert left.columns == odd.columns and {r["_id"] for r in left.collect()} == {7}


@pytest.mark.parametrize("shared", [None, 7])
def test_ngram_join_tells_texts_of_one_identifier_apart(spark, shared):
    """A document unlike all others and a near copy of document 3 under one identifier, both ways round."""
    base, other = ([f"{x}{i}" for i in range(100)] for x in "bo")
    near, twin = " ".join([*base, "tail"]), " ".join([*other, "end"])
    third = " ".join(f"t{i}" for i in range(100))
    rows = [(shared, " ".join(other)), (shared, near), (3, " ".join(base)), (shared, third), (5, "x y z"), (shared, twin)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        texts = {r["text"] for r in ngram_join.one_of_each(df, n=4, percent=85).collect()}
        assert len(texts) == 4 and {" ".join(base), third, "x y z"} < texts and len(texts & {" ".join(other), twin}) == 1
        got = ngram_join.similar_components(df, n=4, percent=85).collect()
        assert sorted((key(r["doc_id"]), key(r["component_id"])) for r in got) == sorted([(3, 3), (5, 5), (key(shared), 3), *[(key(shared), key(shared))] * 3])


def test_empty_tables(empty):
    assert exact_dedup.content_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).columns == empty.columns
    assert line_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert ngram_join.similar_components(empty).count() == 0
    assert ngram_join.one_of_each(empty).count() == 0


def test_kept_text_goes_with_its_digest(docs):
    for r in substring_dedup.remove_repeats(docs.filter(F.col("doc_id") < 50)).collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("sample_a_range", [2, 100])
def test_exact_dedup_of_hot_texts(spark, docs, sample_a_range):
    """Copies of one text, of more than half the rows, lie in several ranges or in one and stay one group."""
    copies = docs.filter("length(text) > 100").orderBy("doc_id").limit(1).withColumn("doc_id", F.explode(F.sequence(F.lit(10000), F.lit(10399))))
    table = docs.unionByName(copies.withColumn("doc_id", F.col("doc_id").cast("long")))
    runs = exact_dedup.runs(table, "doc_id", "text", sample_a_range=sample_a_range)
    # the sort sees all copies of a text in one run, or in one for each share of a hot text
    assert runs.filter("not _hot").groupBy("_norm").agg(F.count(F.lit(1)).alias("c"), F.max("_n").alias("n")).filter("c <> n").isEmpty()
    assert sample_a_range == 100 or runs.filter("_hot").select("_norm", "_salt").distinct().count() > 1
    norm = Counter(re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in pairs(table))
    got = exact_dedup.content_groups(table, sample_a_range=sample_a_range).collect()
    assert Counter(r["text_sha256"] for r in got) == {hashlib.sha256(k.encode()).hexdigest(): n for k, n in norm.items()}
    size = Counter(r["text_sha256"] for r in got)
    assert all(r["group_size"] == size[r["text_sha256"]] for r in got) and sum(r["kept"] for r in got) == len(norm)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {r["doc_id"] for r in exact_dedup.drop_copies(table, sample_a_range=sample_a_range).collect()} == kept
    assert exact_dedup.drop_copies(table, sample_a_range=sample_a_range).count() == len(norm)


def test_rows_of_one_identifier_keep_their_own_marks(spark):
    """A passage beside a text whose hash begins alike, both under identifier 7: only the passage's copy loses words."""
    short = "alpha beta8493"
    head = [f"p{i}" for i in range(40)]
    table = lambda long_: spark.createDataFrame([(1, " ".join(head)), (7, long_), (7, short), (7, "alpha beta41373")], "doc_id long, text string")
    got = substring_dedup.remove_repeats(table(" ".join(head) + " more")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 40, 0), (7, 2, 0), (7, 2, 0), (7, 41, 40)]
    first = spark.createDataFrame([(1, short + " " + " ".join(head)), (7, short), (7, "alpha beta41373 " + " ".join(head))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(first).collect()) == [(1, 42, 0), (7, 2, 0), (7, 42, 40)]
