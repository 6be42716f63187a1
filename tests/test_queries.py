"""Every query of the engine against its SQL."""

import pytest

import __spark_entry__ as entry_points
from conftest import SMALL, compare
from lodestar.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
