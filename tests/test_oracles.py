"""Every query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import difference, oracle_connection
from conftest import SMALL
from demandlens.plans import oracles
from demandlens.plans import queries as plans

QUERIES, SQL = plans.QUERIES, oracles.STATEMENTS


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(SMALL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_entry_offers_them():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, SMALL), connection, SQL[name]) is None
