"""Every registered query against its SQL at the smallest scale."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_point
from logspark.plans.oracles import ORACLES
from logspark.plans.queries import QUERIES

SF_DIR = entry_point.SMOKE_DIR

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def test_flagship(spark):
    assert entry_point.entry(spark).count() > 0


def test_registered_together():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = entry_point.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = sql.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    got = Counter(tuple(row) for row in df.select(*columns).collect())
    assert got == expected and got


SORTED = {
    "time_sorted": ("epoch_sec", "nanos"),
    "unique_entries": ("epoch_sec", "nanos"),
    "combined_report": ("epoch_sec", "nanos"),
    "combine_tree": ("epoch_sec", "nanos"),
    "file_report": ("file",),
    "mixed_file_ratios": ("error_hundredths",),
}


@pytest.mark.parametrize("name", sorted(SORTED))
def test_query_order(spark, name):
    rows = entry_point.queries()[name](spark, SF_DIR).collect()
    keys = [tuple(row[c] for c in SORTED[name]) for row in rows]
    assert keys == sorted(keys) and len(keys) > 1
