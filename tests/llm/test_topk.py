import math
import random

import duckdb
import numpy as np

from docloom.llm import topk
from docloom.llm.queries import ORACLES


def brute(rows, k, every):
    """By rows, not ids: a query's candidates are all rows but its own, a twin with the same id included."""
    used = []
    for i, v in rows:
        if i is not None and v is not None and not any(x is None or not math.isfinite(x) for x in v):
            used.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out, limit = [], 1 << 63
    for n, (i, q) in enumerate(used):
        if i % every == 0:
            best = sorted((-max(-limit, min(limit - 1, sum(a * b for a, b in zip(q, w)))), j) for m, (j, w) in enumerate(used) if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, q string")
    return sorted(map(tuple, topk.top_k(df, **kw).select("query_id", "rank", "vec_id", "score").collect()))


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(1000 + i, [0.5] * 8) for i in range(40)]
    assert got(spark, rows, every=10, block_rows=64) == brute(rows, 5, 10)
    assert got(spark, rows, every=10, query_block=7) == brute(rows, 5, 10)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (0, [0.5, 9.0]), (50, [0.0, 0.0]), (100, [-1.0, 1e6]), (None, [1.0])]
    assert got(spark, rows) == brute(rows, 5, 50)


def test_repeated_rows(spark, tmp_path):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [0.5, 0.5]), (50, [1.0, -1.0]), (50, [1.0, -1.0]), (50, [4.0, 0.0]), (0, [2.0, 2.0]), (3, [3.0, 1.0])]
    assert got(spark, rows) == brute(rows, 5, 50)
    assert (0, 2, 1, 262144) in got(spark, rows)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/e")
    sql = duckdb.sql(ORACLES["op6_topk"].replace("FROM embeddings", f"FROM '{tmp_path}/e/*.parquet'")).fetchall()
    assert sorted(sql) == brute(rows, 5, 50)


def test_huge_values(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e30, -1e30, 3e38, 2e9, 1.0, 0.0]) for _ in range(3)]) for i in range(60)] + [(0, [1e-30, 1.0, 2.0])]
    assert got(spark, rows, every=5) == brute(rows, 5, 5)
    df = spark.createDataFrame([(0, [1e308]), (50, [1.0]), (1, [2.0]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df).orderBy("rank").collect()] == [(50, 1, 1, 131072), (50, 2, 2, -(1 << 63))]


def test_none(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, [1.0])]) == []
