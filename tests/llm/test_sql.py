"""Queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tracewright.llm.queries import ORACLE, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DIR):
        duck.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    df, want = QUERIES[name](spark, DIR), duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in order) for r in df.collect())
    at = [want.columns.index(c) for c in order]
    assert got == sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())
