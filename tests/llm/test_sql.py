"""Queries of the subpackage against their SQL."""

import pytest

from conftest import SMALL, compare
from lodestar.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    compare(spark, name, registry.queries()[name], registry.oracle_sql()[name], SMALL)


def test_names():
    assert sorted(int(x[2:].split("_")[0]) for x in registry.queries()) == list(range(1, 14))
