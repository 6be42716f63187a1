"""Strings inside texts against brute force, and many strings that are not sought in each text one by one."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import expand, inside

TEXTS = ["the cross-encoder re-ranks", "Pump pumps PUMPED a_b-c", "ñandú año1 the", "", None, "ab cd-ab abc", "x-ab", "many ab. cd, the_ab"]
TERMS = ["pump", "pumps", "ab", "cd", "a_b", "cross-encoder", "año1", "the", "re-rank", "year", "encoders", "b-c"]


@pytest.mark.parametrize("texts, asked", [(512, 2048), (3, 2)])
def test_holding(spark, monkeypatch, texts, asked):
    monkeypatch.setattr(inside, "TEXTS", texts)
    monkeypatch.setattr(inside, "ASKED", asked)
    r = random.Random(3)
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    questions = [(f"q{k}", r.sample(TERMS, r.randint(0, 5))) for k in range(20)]
    got = inside.holding(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(questions, "query_id string, terms array<string>"), 0.5)
    want = set()
    for q, terms in questions:
        for k, t in rows:
            hits = sum(x in (t or "").lower() for x in terms)
            if terms and hits >= max(1, math.ceil(len(terms) / 2)):
                want.add((q, k, hits))
    assert {tuple(x) for x in got.collect()} == want and want


def test_telling_of_odd_and_plain_terms(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    terms = [(1, t) for t in TERMS] + [(2, "a_b-c x"), (2, "re-ranks!"), (2, "ab. cd"), (2, "d-a")]
    got = {r.term for r in expand.telling(spark.createDataFrame(terms, "query_id long, term string"), rows, 0.2).collect()}

    def held(term, text):
        low = text.lower()
        return term[: max(4, len(term) - 1)] in low if len(term) >= 4 else term in re.findall(r"\w+", low)

    assert got == {t for _, t in terms if sum(held(t, x) for x in TEXTS if x is not None) <= 0.2 * len(TEXTS)}


def test_many_terms(spark):
    """Five thousand terms and a thousand texts of a thousand words."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda k: F.concat(F.lit("w"), F.conv(F.pmod(F.hash(k, F.col("id")), F.lit(60_000)).cast("string"), 10, 26))), " ")
    texts = spark.range(1000).select("id", words.alias("text"))
    terms = spark.range(5000).select(F.lit(1).alias("query_id"), F.concat(F.lit("w"), F.conv((F.col("id") * 7).cast("string"), 10, 26)).alias("term")).distinct()
    began = time.time()
    assert expand.telling(terms, texts).count() > 0
    assert time.time() - began < 30
