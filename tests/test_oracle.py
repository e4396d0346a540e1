"""Registered queries against DuckDB on the same files."""

import math
import os

import duckdb
import pytest

from colonnade.catalogue import ORACLE, QUERIES, TABLES

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    own = [df.columns.index(names[i]) for i in order]
    key = lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r]
    left = sorted(([_plain(r[i]) for i in own] for r in got), key=key)
    right = sorted(([_plain(r[i]) for i in order] for r in want.fetchall()), key=key)
    assert left == right
