"""Bonds and light: what a task holds doesn't grow with the links."""

import math
import random
from collections import Counter

from conftest import SMALL

from lodestar.operators import graph as G
from lodestar.plans import q_graph


def test_links_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(G, "TASK_ROWS", 300)
    assert q_graph.pairs_of(spark, SMALL).rdd.getNumPartitions() == 20  # 6,000 links; shuffles have 8 partitions
    assert G.strengths(q_graph.pairs_of(spark, SMALL), 20).rdd.getNumPartitions() == 20


def test_strengths_and_glow_against_brute_force(spark, monkeypatch):
    r = random.Random(7)
    pairs = {(a, b): (r.choice([0.1, 0.2, 0.3, 1.0]), r.choice([0, 0, 1, 2, 5])) for a, b in ((r.randint(0, 40), r.randint(0, 40)) for _ in range(120)) if a != b}
    into, out = Counter(b for (a, b), x in pairs.items() if x[0] >= 0.15), Counter(a for (a, b), x in pairs.items() if x[0] >= 0.15)
    rare = lambda n: math.log2(3) / math.log2(2 + max(1, n))
    strong = {}
    for (a, b), (base, bodies) in pairs.items():
        own = base * ((1 + 0.25 * (min(bodies, 3) - 1)) if bodies else 1) * (1.2 if bodies and base >= 0.3 and pairs.get((b, a), (0, 0))[1] else 1)
        strong[a, b] = (own * rare(into[b]), 0.8 * own * rare(out[a]))
    bond = {}
    for (a, b), x in strong.items():
        for e in ((a, b), (b, a)):
            bond[e] = max(bond.get(e, 0), 0.35 + 0.65 * min(1.0, max(x) / 0.6))
    light, ring = {1: (0, 1.0)}, {1: 1.0}
    for hop, fade in enumerate((0.95, 0.74, 0.79), 1):
        near = {}
        for (a, b), x in bond.items():
            if a in ring and b not in light:
                near[b] = max(near.get(b, 0), round(ring[a] * x * fade, 9))
        ring = near
        light |= {k: (hop, v) for k, v in ring.items()}
    df = spark.createDataFrame([(a, b, base, "sentence", n, n + 1) for (a, b), (base, n) in pairs.items()], "a long, b long, base double, kind string, bodies long, n long")
    start = spark.createDataFrame([(1,)], "id long")
    import lodestar.operators.retrieval as R

    for few, parts in ((100_000, None), (3, 5)):  # degrees and rings that go to all tasks, and that are shuffled
        monkeypatch.setattr(R, "TOLD", few)
        got = G.strengths(df, parts)
        assert {(x.a, x.b): (round(x.out_strength, 9), round(x.in_strength, 9)) for x in got.collect()} == {k: (round(x, 9), round(y, 9)) for k, (x, y) in strong.items()}
        found = {x.id: (x.hop, round(x.light, 6)) for x in G.glow(got, start, parts=parts).collect()}
        assert found == {k: (h, round(v, 6)) for k, (h, v) in light.items()} and max(h for h, _ in found.values()) == 3
