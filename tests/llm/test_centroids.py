"""Yinyang against plain rounds in whole numbers, and how many distances it saves."""

import hashlib
import math
import random

import pytest

from lodestar.llm import centroids


def direct(vectors, k, rounds, dimensions, seed):
    kept = []
    for i, v in vectors:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(x * 1024) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in order[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((d(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *nearest(v)) for i, v in kept]
    by = {}
    for _, dist, j in got:
        by[j] = by.get(j, 0) + dist
    return sorted(((i, j, dist, by[j], sum(by.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, dist, j in got), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(seed, n, dimensions, step):
    """Few distinct values, so that distances tie."""
    r = random.Random(seed)
    out = [(i, [r.choice([-1, 0, 0, 1]) * step + (i % 5) * 3 * step for _ in range(dimensions)]) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0] * (dimensions - 1), [1.0] * (dimensions + 1), [None] + [1.0] * (dimensions - 1), [nan] * dimensions, [inf] + [0.0] * (dimensions - 1), [-inf] * dimensions]
    return out + [(n + i, v) for i, v in enumerate(bad)] + [out[3], (None, out[4][1]), (3, out[5][1])]


@pytest.mark.parametrize("groups", [1, 3, 7])
@pytest.mark.parametrize("step", [1 / 1024, 0.3])
def test_clusters(spark, monkeypatch, groups, step):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    given = vectors(2, 300, 4, step)
    df = spark.createDataFrame([(i, v, 1) for i, v in given], "vec_id long, embedding array<double>, cluster int").repartition(3)
    measured = []
    got = rows(centroids.clusters(df, k=7, rounds=6, dimensions=4, groups=groups, measured=measured))
    assert got == direct(given, 7, 6, 4, "3")
    assert len(measured) == 7 and measured[0] == 7 * len(got)
    if groups > 1 and step == 0.3:
        assert measured[-1] < measured[0] / 2  # bounds spare most distances once centroids hardly move


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.clusters(spark.createDataFrame([], schema)).collect() == []
    assert centroids.clusters(spark.createDataFrame([(1, None)], schema)).collect() == []
    given = [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, [0.5, 1.0])]
    assert rows(centroids.clusters(spark.createDataFrame(given, schema), k=8, rounds=3, dimensions=2)) == direct(given, 8, 3, 2, "3")


def test_too_large(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.clusters(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), dimensions=2).collect()
