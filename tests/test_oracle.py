"""Every query that has SQL gives the SQL's rows."""

import os
from decimal import Decimal

import duckdb
import numpy as np
import pytest

from sparkarray.plans import catalogue

SIZES = ("sf0.001", "sf0.1")


@pytest.fixture(scope="module")
def duck():
    found = {}
    for sf in SIZES:
        found[sf] = duckdb.connect()
        for f in os.listdir(f"/root/testdata/{sf}"):
            found[sf].sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '/root/testdata/{sf}/{f}'")
    return found


def close(a, b):
    """Doubles agree to 12 digits or to what both were rounded to; all else exactly."""
    if isinstance(a, float) or isinstance(b, float):
        return abs(a - b) <= max(1e-12 * abs(a), 1.5e-4)
    return a == b


def value(x):
    if x is None or x != x:
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    return float(x) if isinstance(x, (float, np.floating, Decimal)) else int(x) if isinstance(x, (int, np.integer)) else x


def plain(rows):
    """Rows in an order in which doubles come last."""
    rows = [tuple(value(x) for x in r) for r in rows]
    return sorted(rows, key=lambda r: (*((x is None, "" if x is None else str(x)) for x in r if not isinstance(x, float)), *(round(x, 3) for x in r if isinstance(x, float))))


@pytest.mark.parametrize("sf", SIZES)
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, name, sf):
    sql = catalogue.ORACLE_SQL[name]
    got = catalogue.QUERIES[name](spark, f"/root/testdata/{sf}")
    if sf == "sf0.1" and "list_append" in sql:  # the SQL copies its list at each of 100,000 rows: the query must run, its rows are compared on the small table
        assert got.count() == 100_000
        return
    found = duck[sf].sql(sql)
    assert sorted(found.columns) == sorted(got.columns)
    a, b = plain(found.fetchall()), plain(got.select(*[f"`{c}`" for c in found.columns]).collect())
    assert len(a) == len(b)
    assert all((x is None) == (y is None) and (x is None or close(x, y)) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def differing(spark, name, path):
    """Rows of a query on the events of a folder that are not the SQL's, to the last bit."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    found = con.sql(catalogue.ORACLE_SQL[name])
    a, b = sorted(found.fetchall()), sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(path)).select(*found.columns).collect())
    assert len(a) == len(b)
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y]


def awkward_events(path):
    """Nulls, also at the start and over whole blocks; means on ties; both signs; at last large values with a small spread."""
    values = "CASE WHEN i < 3 OR i BETWEEN 100 AND 180 THEN NULL WHEN i < 2000 THEN (i * 37 % 81 - 40) * 0.05 ELSE 1e7 + i * 7 % 500 / 100 END"
    duckdb.sql(f"COPY (SELECT i AS event_id, CAST({values} AS DOUBLE) AS value FROM range(6000) r(i)) TO '{path}/events.parquet'")
    return path


def test_welford_by_sums_is_the_sql_to_the_last_bit(spark, tmp_path):
    assert differing(spark, "scan_welford", "/root/testdata/sf0.01") == []
    assert differing(spark, "scan_welford", awkward_events(tmp_path)) == []


def test_welford_by_merging_is_the_sql_to_the_last_bit(spark, tmp_path):
    assert differing(spark, "scan_welford_merge", "/root/testdata/sf0.01") == []
    assert differing(spark, "scan_welford_merge", awkward_events(tmp_path)) == []
