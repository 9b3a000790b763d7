"""Every registered query against its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = os.environ.get("PAGEMILL_TEST_SF", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    difference = compare(spark, con, SF, QUERIES[name], SQL[name])
    assert difference is None, difference


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).limit(5).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
