"""Every query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from ledgerloom.plans import catalog
from tests.oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracles())


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["cik", "fiscal_year"] and frame.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, connection, name):
    problem, rows = compare(spark, connection, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None and rows > 0
