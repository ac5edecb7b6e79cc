"""Registered queries against their SQL at the smallest scale: all of them."""

import os

import pytest

import __spark_entry__ as entry
from accordant.plans import catalog
from oracle_check import compare, connect

ROOT = "/root/testdata/sf0.001"
QUERIES, SQL = dict(catalog.QUERIES), dict(catalog.SQL)

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, message, _ = compare(spark, con, QUERIES[name], SQL.get(name), ROOT)
    assert ok, message


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "eq_a1_a2" in df.columns
