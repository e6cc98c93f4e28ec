"""Every registered query against its SQL, and the session settings they must not depend on."""

import pytest
from support import SF
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql
from fleetlens.catalog.oracle import ORACLES
from fleetlens.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert ORACLES.items() <= oracle_sql().items()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, tables, name):
    _, difference = compare(spark, tables, SF, QUERIES[name], ORACLES[name])
    assert difference is None


def test_entry(spark):
    assert entry(spark).count() > 0
