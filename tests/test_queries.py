"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from siftgate.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    assert compare(entry.queries()[name](spark, SF), db, entry.oracle_sql()[name]) is None
