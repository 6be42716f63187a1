"""Spelling variants against all words with all words, and what makes groups large."""

import random
import re
import zlib
from collections import Counter

import pytest

from lodestar.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string"


def direct(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            n[low] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [x for x in n if x != w and near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(by[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n)


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, letters, n):
    r = random.Random(seed)
    stems = ["".join(r.choices(letters, k=r.choice([6, 7, 8, 12, 40]))) for _ in range(12)]
    made = []
    for k in range(n):
        words = []
        for _ in range(r.choice([0, 5, 60])):
            w = stems[min(int(r.expovariate(0.5)), 11)]
            if r.random() < 0.3:
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]])
            words += [w] * r.choice([1, 1, 12]) + [r.choice(["É", "ab1", "Short", "—"])]
        made.append((k, " ".join(words).replace("a", "A", 3)))
    return made


@pytest.mark.parametrize("hot", [1 << 15, 3])
@pytest.mark.parametrize("letters", ["ab", "aeéÿx×"])
def test_variants(spark, letters, hot):
    """With two letters nearly all words share their grams, so that groups go on under more grams."""
    docs = corpus(7, letters, 40)
    docs += [(41, None), (42, ""), (None, "Variant variant variants"), (3, docs[3][1]), (43, "x" * 5000 + " " + "x" * 5001 + " " + "x" * 5000 + " " + "x" * 5001)]
    df = spark.createDataFrame([(*x, "w", "n") for x in docs], SCHEMA).repartition(3)
    want = direct(docs)
    assert rows(spelling.variants(df, hot)) == want
    assert any(w[1] for w in want) and any(w[4] for w in want)


def test_chains_and_ties(spark):
    """Forms lead on to forms; of equally frequent ones the smallest in code-point order is taken."""
    said = lambda w, n: f"{w} " * n
    safe = lambda w: next(k for k in range(10_000) if zlib.crc32(f"{k}:{w}".encode()) % 31)
    docs = [(safe(w), said(w, n)) for w, n in (("worldly", 2), ("worldlyx", 20), ("worldlyxy", 200), ("abcdefgh", 30), ("abcdefgé", 30), ("abcdefg", 3))]
    got = rows(spelling.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == direct(docs)
    by = {r[0]: r for r in got}
    assert by["worldly"][1:3] == ("worldlyx", "worldlyxy") and by["abcdefg"][1] == "abcdefgh"


def test_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")).collect() == []
