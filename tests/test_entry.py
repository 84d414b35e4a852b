"""The driver contract on the smallest test data."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_ranked_hits(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["query_id", "rank"]
    assert df.count() == 40 * 8


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    good, note = compare(spark, con, name, SF, entry.oracle_sql().get(name))
    assert good, note
