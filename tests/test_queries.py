"""Every registered query against its SQL, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    status, rows, _, note = compare(spark, con, name, QUERIES[name], SQL.get(name), FOLDER)
    assert status in ("ok", "rows-only"), note
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_registered():
    assert set(SQL) <= set(QUERIES)
