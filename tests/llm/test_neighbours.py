"""Exact results on vectors of many kinds, and what a query sends to other tasks."""

import json
import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from callgrid.llm import neighbours


def test_a_query_visits_a_bounded_number_of_buckets():
    """Of vectors without structure, the mass lies in thousands of buckets; the likeliest are taken."""
    x = np.random.default_rng(2).standard_normal((4000, 64))
    few, all_ = (neighbours.Geometry(64, x[:2048], 9, 2, 12, 2.0, 11, most) for most in (32, 1 << 12))
    for t in range(2):
        for some, more in zip(few.probes(x[:20], t, 0.72), all_.probes(x[:20], t, 0.72)):
            assert len(some) == 32 < len(more) and set(some.tolist()) < set(more.tolist())


def truth(rows, asked, k=10):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = []
    for q, v in rows:
        if q in asked:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
            out += [(q, r, int(ids[j]), d[j]) for r, j in enumerate(order, 1)]
    return out


def kinds():
    rng = np.random.default_rng(5)
    n = 3000
    noise = rng.standard_normal((n, 24))
    yield "scales", noise * rng.lognormal(0, 2, (n, 1))
    yield "one far group", np.where(np.arange(n)[:, None] % 50 == 0, 40 + 0.01 * noise, noise)
    yield "clusters of many widths", rng.standard_normal((30, 24))[rng.integers(30, size=n)] * 5 + noise * rng.lognormal(-3, 2, (n, 1))
    yield "few values", rng.integers(0, 2, (n, 24)).astype(float) + (np.arange(n) % 7 == 0)[:, None]
    yield "a line", np.outer(rng.standard_normal(n) ** 3, np.ones(24)) + 1e-3 * noise
    yield "far from the origin", 1e6 + noise


KINDS = list(kinds())


@pytest.mark.parametrize("name,x", KINDS, ids=[name for name, _ in KINDS])
def test_nearest_are_the_true_ones(spark, name, x):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, table.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    want = truth(rows, set(range(0, len(rows), 100)))
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(found & {(q, i) for q, _, i, _ in want}) / len(want) == 1
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
    assert np.allclose([r["score"] for r in got], [w[3] for w in want], rtol=1e-12, atol=0)


def sizes():
    rng = np.random.default_rng(6)
    n = 1500
    noise = rng.standard_normal((n, 8))
    clusters = rng.standard_normal((20, 8))[rng.integers(20, size=n)] + 0.01 * noise
    odd = np.arange(n)[:, None] % 2 == 1
    yield "small", 1e-200 * noise
    yield "small clusters", 1e-162 * clusters
    yield "subnormal", 1e-310 * noise
    yield "large", 1e200 * noise
    yield "large clusters", 1e160 * clusters
    yield "the largest", 1e307 * noise
    yield "small beside usual", noise * np.where(odd, 1, 1e-170)
    yield "large beside usual", noise * np.where(odd, 1, 1e170)
    yield "all sizes", noise * 10 ** rng.uniform(-300, 300, (n, 1))
    # of the largest components, differences and distances overflow: all are infinite, and ties
    yield "beyond doubles", 1.7e308 * np.sign(rng.standard_normal((n, 14)))


SIZES = list(sizes())


@pytest.mark.parametrize("name,x", SIZES, ids=[name for name, _ in SIZES])
def test_components_of_any_size(spark, name, x):
    """Squares that overflow or vanish leave neither a query without result nor its neighbours out."""
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(table, table.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    want = []
    for q, v in rows[::100]:
        own = sorted((math.dist(v, w), i) for i, w in rows if i != q)[:10]
        want += [(q, r, i, d) for r, (d, i) in enumerate(own, 1)]
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
    assert np.allclose([r["score"] for r in got], [w[3] for w in want], rtol=1e-12, atol=0)


def test_a_far_query_lists_few_cells():
    """One whose k-th sample vector is 10 ** 12 times farther than usual has as many cells within its spread."""
    x = np.random.default_rng(3).standard_normal((3000, 8))
    geometry = neighbours.Geometry(8, x[:2048], 9, 2, 12, 2.0, 11, 32)
    for t in range(2):
        for visits in geometry.probes(np.array([x[0] * 1e12, x[0] * 1e300]), t, 0.72):
            assert 1 <= len(visits) <= 32


SMALL_DRIVER = """
import json, sys
from pyspark.sql import SparkSession
from callgrid.llm import neighbours

conf = {"spark.driver.maxResultSize": "4m", "spark.sql.autoBroadcastJoinThreshold": sys.argv[2], "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"}
spark = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
neighbours.CHUNK_VALUES = 1 << 11
table = spark.read.parquet(sys.argv[1])
got = neighbours.nearest(table, table.filter("vec_id % 5 = 0")).orderBy("query_id", "rank").collect()
print("GOT", json.dumps([tuple(r)[:3] for r in got]))
"""


@pytest.mark.parametrize("limit", ["10m", "500k"])
def test_copies_of_queries_do_not_pass_through_the_driver(spark, tmp_path, limit):
    """400 queries are sent to 64 buckets and to 63 shares, 13 MB each time; the driver takes 4 MB here. The file
    is within the first limit of broadcasts, so that 64 copies of its queries seem to be, too. Within the second
    are only the queries, so that copies for all shares seem to be."""
    x = np.random.default_rng(8).standard_normal((2000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/rows")
    run = subprocess.run([sys.executable, "-c", SMALL_DRIVER, f"{tmp_path}/rows", limit], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    want = truth(rows, set(range(0, len(rows), 5)))
    assert json.loads(run.stdout.rpartition("GOT")[2]) == [list(w[:3]) for w in want]
