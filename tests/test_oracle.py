"""Every query with a DuckDB statement gives the same rows."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from verification import oracle, registry

SF = "/root/testdata/sf0.01"
QUERIES, STATEMENTS = registry.queries(), oracle.statements()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        name = file.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{file}')")
    return connection


def test_every_statement_belongs_to_a_query():
    assert set(STATEMENTS) <= set(QUERIES)
    assert set(QUERIES) - set(STATEMENTS) == {"report_bundle"}
    assert set(QUERIES) <= set(entry.queries()) and set(STATEMENTS) <= set(entry.oracle_sql())


def _sorted(rows):
    return sorted(rows, key=lambda row: [(v is not None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_rows_equal(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = [tuple(row[c] for c in columns) for row in frame.collect()]
    result = duck.execute(STATEMENTS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert found, "a query that checks nothing"
    assert _sorted(found) == _sorted(expected)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r.step for r in rows][:2] == ["Total Users", "View Items"] and len(rows) == 7
