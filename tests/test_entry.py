from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.check import compare, open_tables
from tests.conftest import SF_DIR

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return open_tables(SF_DIR)


def test_every_counterpart_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 7


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, SF_DIR, name, ORACLES[name]) == ""
    else:
        assert entry.queries()[name](spark, SF_DIR).count() > 0
