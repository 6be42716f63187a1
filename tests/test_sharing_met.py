"""Notes that share topics are met at their smaller note, not sorted by pairs."""

import random

from lodestar.operators import graph


def test_pairs_are_not_aggregated_by_spark(spark):
    got = graph.sharing(spark.range(300).selectExpr("id AS note", "id % 3 AS topic"))
    assert got.count() == 3 * 100 * 99
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if ("Aggregate" in x or "Sort" in x) and "nb#" in x]


def test_notes_longer_than_a_batch(spark):
    """A note's rows in several batches of two, names and topics that are strings, nulls."""
    r = random.Random(6)
    rows = list({(f"n{r.randrange(30)}", f"t{r.randrange(12)}") for _ in range(150)})
    conf, name = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = conf.get(name)
    conf.set(name, "2")
    try:
        df = spark.createDataFrame([*rows, (None, "t1"), ("n1", None)], "note string, topic string")
        got = {(x.id, x.nb): (x.n, x.topics) for x in graph.sharing(df).collect()}
    finally:
        conf.set(name, had)
    of = {k: {t for n, t in rows if n == k} for k, _ in rows}
    assert got == {(a, b): (len(of[a] & of[b]), "|".join(sorted(of[a] & of[b]))) for a in of for b in of if a != b and of[a] & of[b]}
