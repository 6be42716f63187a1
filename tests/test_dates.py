"""Dates of questions in sections."""

from pyspark.sql import functions as F

from lodestar.operators import dates


def test_date_hits(spark):
    texts = [
        ("a", 0, "on 2026-09-24 and again 2026-09-24"), ("a", 1, "```\nlog2026-09-24x\n``` and 12026-09-241"), ("b", 0, "2026-09-24, 2026-09-25"), ("b", 1, "2026-9-24"), ("c", 0, None), ("c", 1, ""), ("d", 0, "x2026-09-25-26"),
    ]
    texts += [("z", k, "at 2025-01-01") for k in range(60)]
    index = dates.date_index(spark.createDataFrame(texts, "note string, ord int, text string"))
    asked = spark.createDataFrame(
        [(1, "2026-09-25 or 2026-09-24?"), (2, "x2026-09-24, 2026-09-240"), (3, None), (4, "2025-01-01"), (5, "2026-09-24 2026-09-24")], "query_id int, text string"
    ).select("query_id", dates.dates_of(F.col("text")).alias("dates"))
    got = {}
    for r in dates.date_hits(index, asked).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.note, r.ord))
    # a section with two dates votes twice; what stands inside a word counts in a section, not in a question
    first = [("a", 0), ("a", 1), ("b", 0)]
    assert got == {1: [("b", 0), ("d", 0), *first], 4: [("z", k) for k in range(40)], 5: first + first}
    assert dates.date_hits(index.limit(0), asked).collect() == []
