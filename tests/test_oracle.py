"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest
from conftest import SMALL
from oracle_check import compare, duck

import __spark_entry__ as entry_points
from sparkwarden.catalog.queries import REGISTRY as QUERIES

STATEMENTS = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return duck(SMALL)


def test_every_query_has_a_statement():
    assert set(QUERIES) <= set(STATEMENTS)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SMALL, QUERIES[name], STATEMENTS[name]) is None


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"source", "rule", "severity", "n"}
