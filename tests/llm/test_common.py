"""Joins with facts of keys, and files that are deleted."""

from collections import Counter

import pytest

from lodestar.llm import common


@pytest.mark.parametrize("most", [0, 50_000])
def test_beside(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST", most)
    rows = [(k, "hot" if k % 3 else None) for k in range(300)] + [(900, "cold"), (901, "none"), (900, "cold")]
    facts = spark.createDataFrame([("hot", 1), ("cold", 2), ("unused", 3)], "host string, v int")
    got = Counter(map(tuple, common.beside(spark.createDataFrame(rows, "k long, host string"), facts, "host").select("k", "host", "v").collect()))
    assert got == Counter((k, h, {"hot": 1, "cold": 2}.get(h)) for k, h in rows)
    assert common.beside(spark.createDataFrame(rows, "k long, host string"), facts.limit(0), "host").count() == len(rows)


def test_stored_files_go(spark):
    import os

    df = common.stored(spark.range(10), "x")
    at = df.stored_at.removeprefix("file://")
    assert os.path.isdir(at) and df.count() == 10 and df.stored_at in common.held
    common.discard(df)
    assert not os.path.exists(at) and df.stored_at not in common.held
