"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from scorelake.plans import all_queries, all_sql

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    problem = compare(QUERIES[name](spark, SF_DIR), duck, SQL[name])
    assert problem is None or problem == "both empty", problem


def test_entry(spark):
    assert entry.entry(spark).count() == 10
