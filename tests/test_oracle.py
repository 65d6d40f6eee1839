"""Every query against its SQL twin on the smallest tables."""

import os

import pytest

import oracle
from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    # the smallest tables hold too few sessions in scope to pair any
    assert QUERIES[name](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 4
