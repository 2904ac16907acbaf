"""Registered queries against their SQL in DuckDB, and the entry points."""

import datetime
import os

import pytest

import __spark_entry__ as entry
from kelpie import queries as own


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [plain(x) for x in v] if isinstance(v, list) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = own.QUERIES[name](spark, sf_dir)
    rel = duck.sql(own.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted([plain(r[i]) for i in order] for r in rel.fetchall())
    assert sorted([plain(v) for v in r] for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert own.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
