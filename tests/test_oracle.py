"""Every registered query with SQL against DuckDB over the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, bool):
        return float(v)
    if v is None or isinstance(v, str):
        return v
    v = float(v)
    return "nan" if math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    got = [tuple(_plain(v) for v in r) for r in df.collect()]
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in df.columns]
    want = [tuple(_plain(r[i]) for i in order) for r in result.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
