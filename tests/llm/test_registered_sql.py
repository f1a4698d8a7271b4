"""The corpus queries that have SQL, against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

from glossa.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, DATA)
    got = duck.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == sorted(map(repr, got.fetchall()))
