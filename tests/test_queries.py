"""Every registered query against its SQL, over whole tables of the smallest scale."""

import pytest

import __spark_entry__ as entry
from pulseframe import catalog
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in ORACLES
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) == ""


def test_entry_lists_the_catalog():
    assert QUERIES.keys() <= entry.queries().keys()
    assert ORACLES.keys() <= entry.oracle_sql().keys()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
