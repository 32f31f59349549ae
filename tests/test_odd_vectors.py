"""Whole queries over vectors that aren't finite, and over ids that come again, against their SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docloom.plans.queries import ORACLES, QUERIES

from .test_queries import plain

NAMES = ["ag08_recall_mrr", "so08_rerank_order", "ag10_citation_precision", "ag07_question_ranks", "jn08_dense_topk"]


def written(d, ids, v, label):
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(v), pa.list_(pa.float32())), "label": label.astype(np.int32)}), d / "embeddings.parquet")
    return str(d)


def agree(spark, tables, name):
    found = QUERIES[name](spark, tables).toArrow()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tables}/embeddings.parquet'")
    columns = sorted(found.column_names)
    want = con.sql(ORACLES[name]).select(*columns).fetchall()
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.to_pylist()) == sorted(tuple(plain(x) for x in r) for r in want)


@pytest.mark.parametrize("name", NAMES)
def test_vectors_that_are_not_finite(spark, tmp_path, name):
    rng, n = np.random.default_rng(8), 1500
    v = rng.normal(size=(n, 6)).astype(np.float32)
    v[[7, 40, 811], [0, 3, 5]] = np.inf, -np.inf, np.nan  # 40 is a query
    agree(spark, written(tmp_path, np.arange(n) * 10, v, rng.integers(0, 3, n)), name)


@pytest.mark.parametrize("name", NAMES)
def test_ids_that_come_again(spark, tmp_path, name):
    rng, n = np.random.default_rng(9), 300
    ids = np.concatenate([np.arange(n) * 10, [10, 20, 100, 150, 150, 2950]])  # 100, 150 and 2950 are queries
    agree(spark, written(tmp_path, ids, rng.normal(size=(len(ids), 6)).astype(np.float32), np.concatenate([np.arange(n) % 3, [2, 0, 0, 1, 0, 1]])), name)
