"""Queries that SQL can express give the SQL's rows."""

import os

import duckdb
import pytest

from sparkarray.llm import queries


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name, sf):
    duck = duckdb.connect()
    for f in os.listdir(f"/root/testdata/{sf}"):
        duck.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '/root/testdata/{sf}/{f}'")
    want = duck.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda xs: sorted(xs, key=str)
    a, b = rows(want.fetchall()), rows(tuple(r) for r in got.select(*want.columns).collect())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
