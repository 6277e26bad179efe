"""Every registered query against its SQL counterpart, on the smallest data set."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    from echolens.plans import oracles, registry
    assert set(registry.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
