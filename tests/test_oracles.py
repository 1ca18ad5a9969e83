"""The engine's own queries against SQL, at the smallest scale."""

import datetime
import os

import duckdb
import pytest

import tideframe.write_queries  # noqa: F401  registers its queries with the others
from tideframe.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def sql():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    want = sql.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())
