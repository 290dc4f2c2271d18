"""Every query of the registry against its SQL, on the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidewright.plans import curation, portable, suites

QUERIES, SQL = portable.QUERIES | curation.QUERIES | suites.QUERIES, portable.SQL | curation.SQL | suites.SQL


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_registry(spark):
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
