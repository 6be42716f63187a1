"""New facts beside current ones, by the places of words."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import facts as O
from lodestar.sources import memory


def made(seed, n, words, sizes=(0, 1, 2, 5, 9, 40)):
    """Facts of words of which the first are frequent; some without terms, some with null ones."""
    pick = random.Random(seed)
    return [None if k % 29 == 7 else list(dict.fromkeys(pick.choice(["é" * 2 + str(int(words * pick.random() ** 3)), None][: 1 + (k % 13 == 5)]) for _ in range(pick.choice(sizes)))) for k in range(n)]


@pytest.mark.parametrize("common, few", [(10, 96), (1, 1), (1 << 30, 5), (3, 1 << 30)])
def test_counts(monkeypatch, common, few):
    """However a word is counted, by a matrix or by the facts that have it, counts are those of sets."""
    monkeypatch.setattr(memory, "COMMON", common)
    monkeypatch.setattr(memory, "FEW", few)
    old, new = ([x or [] for x in made(k, 150, 60)] for k in (1, 2))
    chunk = memory._chunk(pa.table({"old": [f"{k:03}" for k in range(150)], "old_category": ["x"] * 150, "terms": pa.array(old, pa.list_(pa.string()))}))
    got = memory._block(pa.table({"id": [str(k) for k in range(150)], "category": ["x"] * 150, "replaces": pa.array([[]] * 150, pa.list_(pa.string())), "terms": pa.array(new, pa.list_(pa.string()))}))
    of = lambda row, c: row.column(c)[0]
    words = memory._words(of(chunk, "begins").as_buffer(), of(chunk, "words").as_buffer()).to_pylist()
    asked = memory._words(of(got, "asked_begins").as_buffer(), of(got, "asked").as_buffer()).to_pylist()
    codes = np.array([words.index(asked[c]) if asked[c] in words else -1 for c in np.frombuffer(of(got, "codes").as_py(), np.int32)])
    ends, places = np.frombuffer(of(chunk, "ends").as_py(), np.int32).astype(int), np.frombuffer(of(chunk, "places").as_py(), np.uint16).astype(int)
    both = np.concatenate([x for _, x in memory._shared(of(got, "own").values.to_numpy(), codes, ends, places, 150)])
    assert both.tolist() == [[len((set(a) & set(b)) - {None}) for b in old] for a in new]


def test_verdicts_equal_brute_force(spark, monkeypatch):
    """Chunks and blocks of a few facts, categories that are null, ties, facts that are named."""
    monkeypatch.setattr(memory, "CHUNK", 37)
    monkeypatch.setattr(memory, "BLOCK", 11)
    kind = lambda k: [None, "a", "b", "c"][k % 4]
    old = [(f"{(k * 7) % 300}", kind(k), None, t) for k, t in enumerate(made(3, 300, 40, (9, 12, 15)))]
    new = [(f"n{k}", kind(k // 3), None, t, [str(k), str(k + 1)] if k % 5 == 0 else None, k % 17 == 3) for k, t in enumerate(made(4, 200, 40, (0, 3, 12, 18)))]
    columns = "id string, category string, key string, terms array<string>"
    got = memory.remembered(spark.createDataFrame(new, columns + ", named array<string>, force boolean"), spark.createDataFrame(old, columns).repartition(5))
    want = set()
    for i, category, _, terms, named, force in new:
        rows = []
        for o, c, _, t in old if terms is not None else ():
            both = len((set(terms) & set(t)) - {None}) if t is not None else 0
            if both and o not in (named or ()):
                j, share = both / (len(terms) + len(t) - both), both / min(len(terms), len(t))
                rows.append((-max(j, O.CONTAINMENT_SHARE * share), o, c, "duplicate" if j >= O.DUPLICATE_JACCARD or share >= O.DUPLICATE_CONTAINMENT else "update" if j >= O.UPDATE_JACCARD else "new"))
        best, near = min(rows, default=None), min((x for x in rows if category is not None and x[2] == category), default=None)
        if not force and best and best[3] == "duplicate":
            want.add((i, "duplicate", best[1], ()))
        elif not force and not named and near and near[3] == "update":
            want.add((i, "held", near[1], ()))
        else:
            want.add((i, "stored", None, tuple(named or ())))
    assert {(r.id, r.verdict, r.match, tuple(r.replaces)) for r in got.collect()} == want
    assert {v for _, v, _, _ in want} == {"duplicate", "held", "stored"}


def test_question_terms_once(spark):
    """Stop words go by a set, not by a look at all of them for each word."""
    from lodestar.functions.text import query_terms

    row = spark.createDataFrame([("The pump's a PUMP of x iron_ore, what-if -- and pump",), (None,), ("",)], "t string").select(query_terms(F.col("t")).alias("q"))
    assert [r.q for r in row.collect()] == [["pump", "iron_ore", "what-if", "--"], None, []]
