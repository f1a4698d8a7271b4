"""Each query with SQL against DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from glossa.registry import FLAGSHIP, ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return v if isinstance(v, str) else f"{float(v):.6g}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(plain(v) for v in r) for r in got.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flagship():
    assert FLAGSHIP in ORACLES
