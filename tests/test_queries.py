"""Every query of the engine against its SQL, on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from docloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | Decimal):
        return "nan" if math.isnan(v) else f"{float(v) + 0.0:.6g}"
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    found = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLES:
        assert found.num_rows > 0 or name in {"st10_script_check"}
        return
    want = sql.sql(ORACLES[name])
    assert sorted(found.column_names) == sorted(want.columns)
    columns = sorted(found.column_names)
    at = [list(want.columns).index(c) for c in columns]
    left = sorted(tuple(plain(r[c]) for c in columns) for r in found.to_pylist())
    assert left == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
