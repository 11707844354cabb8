"""Every registered query that has SQL gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 6) if hasattr(v, "__float__") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf), duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    rows = sorted(([plain(r[c]) for c in cols] for r in got.collect()), key=repr)
    assert rows == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)
    assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 16
