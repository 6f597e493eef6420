"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from cadenza.plans import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle import connect, difference

# The training-data queries have tests of their own.
ROWS_ONLY = {"sql_approx"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    if name in ROWS_ONLY:
        assert frame.limit(1).count() == 1
    else:
        assert difference(frame, con, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["platform", "territory", "total_revenue", "total_streams"]
    assert frame.count() > 0
