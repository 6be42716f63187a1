"""What search writes: hits dealt out once, the first of each query alone, texts in columns."""

import contextlib
import io
import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from lodestar.lineage import dropped, kept
from lodestar.operators import context as X
from lodestar.operators import retrieval as R


def plan_of(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


def made(spark):
    pick = random.Random(1)
    docs = spark.createDataFrame([(k, [f"w{int(30 * pick.random() ** 2)}" for _ in range(pick.randint(0, 12))]) for k in range(300)], "key long, text array<string>")
    asked = spark.createDataFrame([(q, [f"w{pick.randrange(30)}" for _ in range(1 + q % 4)]) for q in range(40)], "query_id long, terms array<string>")
    return docs, asked.withColumn("terms", F.array_distinct("terms"))


def test_hits_are_shuffled_once(spark):
    docs, asked = made(spark)
    assert not re.search(r"hashpartitioning\([^)]*key#", plan_of(R.bm25(docs, asked, {"text": 1.0})))


def test_first_of_each_query_alone(spark):
    """The limit takes rows away before they are shuffled, and none that is among the first."""
    docs, asked = made(spark)
    scored, n = R.bm25(docs, asked, {"text": 1.0}), asked.select("query_id", F.size("terms").alias("n_terms"))
    for least, most in ((5, 7), (3, 40), (9, 2), (60, 50)):
        few = R.strict_then_loose(scored, n, least, most)
        assert "WindowGroupLimit" in plan_of(few)
        rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "key", "strict", "rank").collect())
        assert rows(few) == rows(R.strict_then_loose(scored, n, least).where(F.col("rank") <= most))


def test_no_text_is_shuffled(spark):
    rows = lambda x, s: spark.createDataFrame(x, s)
    sections = rows([(f"n{k}", o, f"text {k} {o}") for k in range(50) for o in range(2)], "id string, ord int, text string").repartition(4)
    ranked = rows([(1, "n3", 1, 1), (1, "n7", 0, 2), (2, "n3", 0, 1)], "query_id long, note string, ord int, rank int")
    seen = []
    made_, X.cut = X.cut, lambda df: seen.append(plan_of(df)) or made_(df)
    try:
        got = X.pack(ranked, sections).collect()
    finally:
        X.cut = made_
    assert {(r.query_id, r["rank"], r.text) for r in got} == {(1, 1, "text 3 1"), (1, 2, "text 7 0"), (2, 1, "text 3 0")}
    assert any("BroadcastHashJoin" in x and "hashpartitioning" not in x for x in seen)


def test_kept_columns(spark):
    got = kept(spark.range(10).select("id", F.lit(None).cast("string").alias("none"), F.array(F.struct("id")).alias("a")))
    assert got.count() == 10 and got.where("none is null and a[0].id = id").count() == 10
    at = Path(got.kept_at.removeprefix("file://"))
    assert at.exists()
    dropped(got)
    assert not at.exists()
