"""What a Python worker holds while whole queries search many vectors with many queries, and their rows against their SQL."""

import resource
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docloom.plans.queries import ORACLES, QUERIES

from .test_queries import plain


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """4,000 vectors in one Arrow batch, each of them a query of one block."""
    rng, n = np.random.default_rng(6), 4000
    d = tmp_path_factory.mktemp("many")
    v = rng.integers(-4, 5, (n, 8)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": rng.permutation(n) * 50, "embedding": pa.array(list(v), pa.list_(pa.float32())), "label": rng.integers(0, 3, n).astype(np.int32)}), d / "embeddings.parquet")
    return str(d)


def with_peak(spark, run):
    """What run() returns, and the most MB that one of its Python workers held. A new variable in the environment makes new workers."""
    env, name = spark.sparkContext.environment, f"DOCLOOM_{time.time_ns()}"
    env[name] = "1"

    def peak(batches):
        list(batches)
        time.sleep(0.2)  # all workers are asked
        yield pa.record_batch([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1e3])], names=["mb"])

    try:
        return run(), max(r.mb for r in spark.range(0, 8, 1, 8).mapInArrow(peak, "mb double").collect())
    finally:
        del env[name]


@pytest.mark.parametrize("name", ["ag08_recall_mrr", "so08_rerank_order", "ag10_citation_precision"])
def test_workers_hold_few_scores(spark, tables, name):
    found, mb = with_peak(spark, lambda: QUERIES[name](spark, tables).toArrow())
    assert mb < 260  # all scores at once are 128 MB, and more than one copy of them was held; a worker alone has 125
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tables}/embeddings.parquet'")
    columns = sorted(found.column_names)
    want = con.sql(ORACLES[name]).select(*columns).fetchall()
    assert sorted(tuple(plain(r[c]) for c in columns) for r in found.to_pylist()) == sorted(tuple(plain(x) for x in r) for r in want)
