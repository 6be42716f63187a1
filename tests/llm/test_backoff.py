"""The backoff model against a direct computation, and its probabilities' sums."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from lodestar.llm import backoff

WORD = re.compile("[^\x20\x09-\x0d]+")


class Direct:
    """The same model from dictionaries, one token at a time."""

    def __init__(self, docs, order):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        for doc_id, text in docs:
            if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 != 2:
                t = self.tokens(text)
                for i in range(order - 1, len(t)):
                    for n in range(order):
                        self.counts[n][tuple(t[i - n : i + 1])] += 1
        self.d = [backoff.discounts([sum(c == r for c in counts.values()) for r in range(1, 7)]) for counts in self.counts]
        self.after = [Counter() for _ in range(order)]
        self.successors = [{} for _ in range(order)]
        for n in range(order):
            for gram, c in self.counts[n].items():
                self.after[n][gram[:-1]] += c
                self.successors[n].setdefault(gram[:-1], []).append(gram)
        self.N, self.V = sum(self.counts[0].values()), len(self.counts[0])

    def tokens(self, text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return ["<begin>"] * (self.order - 1) + WORD.findall(low) + ["<end>"]

    def seen(self, n, gram):
        c, whole = self.counts[n][gram], self.after[n][gram[:-1]]
        d = self.d[n][c] if c < len(self.d[n]) else 1
        return d * c / (whole + (whole >= len(self.d[n])))

    def p(self, gram):
        n = len(gram) - 1
        if self.counts[n][gram]:
            return self.seen(n, gram)
        if not n:
            return 1 - sum(self.seen(0, g) for g in self.counts[0])
        if not self.after[n][gram[:-1]]:
            return self.p(gram[1:])
        grams = self.successors[n][gram[:-1]]
        return (1 - sum(self.seen(n, g) for g in grams)) / (1 - sum(self.seen(n - 1, g[1:]) for g in grams)) * self.p(gram[1:])

    def row(self, doc_id, text):
        t = self.tokens(text)
        score = sum(math.log10(self.p(tuple(t[i - self.order + 1 : i + 1]))) for i in range(self.order - 1, len(t)))
        real = t[self.order - 1 :]
        base = sum(math.log10((self.counts[0][(x,)] + 1) / (self.N + self.V + 1)) for x in real)
        held = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2
        return (doc_id, held, len(real), sum(self.counts[0][(x,)] > 0 for x in real), self.N, round(base, 6), round(score, 6))


def texts(n):
    r = random.Random(5)
    words = [f"w{k}" for k in range(40)] + ["É", "Ünder", "THE", "the"]
    weights = [1 / (k + 1) for k in range(len(words))]
    out = [(i, r.choice([" ", "\n", "  "]).join(r.choices(words, weights, k=r.choice([0, 1, 2, 30, 200])))) for i in range(n)]
    out += [(n, None), (n + 1, ""), (n + 2, "only here"), (None, "the the"), (4, out[4][1]), (7, "w0 " * 3000)]
    return out


def got(df):
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()], key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, monkeypatch, order):
    docs = texts(150)
    direct = Direct(docs, order)
    df = spark.createDataFrame([(i, t, t) for i, t in docs], "doc_id long, text string, score string").repartition(3)
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 4000)
    assert got(backoff.scores(df, order)) == sorted([direct.row(i, t) for i, t in docs], key=repr)
    # whatever came before, the probabilities of all words and of an unknown one add up to 1
    every = [g[0] for g in direct.counts[0]] + ["never seen"]
    for history in list(direct.after[order - 1])[:50] + [("never seen",) * (order - 1)]:
        assert sum(direct.p((*history, w)) for w in every) == pytest.approx(1, abs=1e-9)


def test_without_training(spark):
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    rows = backoff.scores(spark.createDataFrame([(k, "a b") for k in held], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0.0, 0.0)] * 2
    assert backoff.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_discounts():
    assert list(backoff.discounts([0, 0, 0, 0, 0, 0])) == [1.0]  # nothing to learn from
    d = backoff.discounts([1000, 300, 140, 80, 50, 35])
    assert len(d) == 6 and all(0 < x < 1 for x in d[1:])
    n = [0, 1000, 300, 140, 80, 50, 35]
    # what is taken off counts is what Good-Turing gives to the unseen
    assert sum((1 - d[r]) * r * n[r] for r in range(1, 6)) == pytest.approx(n[1])
    assert list(backoff.discounts([10, 10, 10, 0, 0, 0]))[2:] != [1.0]


def test_hashes_pack():
    import numpy as np

    x = np.array([0, 1, 1 << 63, (1 << 64) - 1], np.uint64)
    assert list(backoff.unpacked(backoff.packed(x), 4)) == list(x)
