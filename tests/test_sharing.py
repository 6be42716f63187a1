"""Notes that share topics against brute force."""

import random

from lodestar.operators import graph


def test_sharing(spark, monkeypatch):
    monkeypatch.setattr(graph, "TOGETHER", 3)
    r = random.Random(5)
    rows = list({(r.randrange(40), r.randrange(12)) for _ in range(150)})
    got = {(x.id, x.nb): (x.n, x.topics) for x in graph.sharing(spark.createDataFrame(rows + rows[:9], "note long, topic long")).collect()}
    of = {k: {t for n, t in rows if n == k} for k, _ in rows}
    want = {(a, b): (len(of[a] & of[b]), "|".join(map(str, sorted(of[a] & of[b])))) for a in of for b in of if a != b and of[a] & of[b]}
    assert got == want


def test_lists_are_shuffled(spark):
    """What is sent by note are lists: far fewer rows than the pairs that come out."""
    df = spark.range(1500).selectExpr("id AS note", "id % 3 AS topic")
    got = graph.sharing(df)
    assert got.count() == 3 * 500 * 499
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "Exchange hashpartitioning(note" in final and "nb#" not in "".join(x for x in final.splitlines() if "Exchange" in x)
