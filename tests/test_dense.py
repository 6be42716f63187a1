"""Dot products by parts."""

from collections import defaultdict

import numpy as np

from lodestar.operators import retrieval as R


def test_best_of_many_matrices(spark):
    """A task passes on a query's best of all its matrices, not of each; equal scores go by key."""
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (400, 4)).astype(float)
    q = rng.integers(-2, 3, (6, 4)).astype(float)
    rows = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(v)] + [(400, None)], "key long, v array<double>").coalesce(1)
    asked = spark.createDataFrame([(k, list(map(float, x))) for k, x in enumerate(q)], "query_id long, q array<double>").coalesce(1)
    got = defaultdict(list)
    for r in R.dense(rows, asked, 3, rows=5).collect():
        got[r.query_id].append((-round(r.score, 6), r.key))
    for k in range(6):
        assert sorted(got[k])[:3] == sorted((-round(float(s), 6), j) for j, s in enumerate(v @ q[k]))[:3]
        assert len(got[k]) <= 3 * 8  # eight parts


def test_tasks_of_keyword_search_are_bounded(spark, monkeypatch):
    """The more rows keys and queries have together, the more tasks add them up, with the same sums."""
    rows = spark.createDataFrame([(k, ["one", "two", f"w{k % 7}"]) for k in range(200)], "key long, text array<string>")
    asked = spark.createDataFrame([(k, ["one", f"w{k % 7}"]) for k in range(10)], "query_id long, terms array<string>")
    sums = lambda df: sorted((r.query_id, r.key, round(r.score, 9), r.matched) for r in df.collect())
    want = sums(R.bm25(rows, asked, {"text": 1.0}))
    monkeypatch.setattr(R, "TASK_ROWS", 100)
    got = R.bm25(rows, asked, {"text": 1.0})
    assert got.rdd.getNumPartitions() >= 20 and sums(got) == want and len(want) == 2000
