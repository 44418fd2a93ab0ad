"""Registered queries against their SQL on the smallest tables.

Queries of the corpus subpackage have their own tests.
"""

import pytest

import __spark_entry__ as entry
from markbook import plans
from oracle import compare, connection

FOLDER = "/root/testdata/sf0.001"
CHOSEN = sorted(plans.QUERIES)


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    problem, rows = compare(spark, con, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert not problem
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
