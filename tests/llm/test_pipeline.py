"""The pipeline, stage by stage, against brute force over what the stage before has kept."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as P  # noqa: E402
from conftest import SMALL  # noqa: E402
from .test_edges import ITEM_WORD, WORD, lower, shingles  # noqa: E402


@pytest.fixture(scope="module")
def states(spark):
    """What each stage got, and the last one's result."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*P.COLUMNS)
    kept = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        kept.append(P.stored(stage(spark, kept[-1], SMALL), f"test{k}"))
    return [{r.doc_id: r for r in x.collect()} for x in kept], [x.columns for x in kept]


def test_columns(states):
    assert all(c == P.COLUMNS for c in states[1][:-1])
    assert states[1][-1] == ["doc_id", "lang", "source", "n_pieces", "ids"]


def test_language(states):
    before, after = states[0][:2]
    assert set(after) == {k for k, r in before.items() if r.text and any(map(str.isalpha, r.text))}


def test_nothing_learned_keeps_all_with_a_letter(spark):
    rows = [(1, "some words"), (2, None), (3, "12 --"), (4, "é"), (5, "")]
    docs = spark.createDataFrame([(k, x, None, "s", 1) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, P.known_language(spark, docs, SMALL).collect())) == [(1, "some words", None, "s", 1), (4, "é", None, "s", 1)]


def test_one_of_each_group(states):
    before, after = states[0][1:3]
    sets = {k: shingles(r.text) for k, r in before.items()}
    least = {}
    ids = sorted(before)
    up = {k: k for k in ids}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    least = {top(k) for k in ids}
    assert set(after) == least


def test_no_repeats(states):
    before, after = states[0][2:4]
    seen, want = set(), {}
    for k in sorted(before):
        w = WORD.findall(before[k].text)
        hit = [False] * len(w)
        for i in range(len(w) - 19):
            one = tuple(w[i : i + 20])
            if one in seen:
                hit[i : i + 20] = [True] * 20
            seen.add(one)
        if not any(hit):
            want[k] = before[k].text
        elif not all(hit):
            want[k] = " ".join(a for a, b in zip(w, hit) if not b)
    assert {k: r.text for k, r in after.items()} == want
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_no_benchmarks(spark, states):
    before, after = states[0][3:5]
    windows = set()
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = ITEM_WORD.findall(lower(r.text or ""))
        size = min(13, len(w))
        windows |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
    sizes = {len(x) for x in windows}
    want = set()
    for k, r in before.items():
        w = ITEM_WORD.findall(lower(r.text))
        hit = [False] * len(w)
        for size in sizes:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit[i : i + size] = [True] * size
        if not (any(hit) and 20 * sum(hit) >= len(w)):
            want.add(k)
    assert set(after) == want


def test_pieces(states):
    import sentencepiece
    from lodestar.llm.pieces import model_path

    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    before, after = states[0][4:6]
    assert set(after) == set(before)
    assert all(list(after[k].ids) == library.encode(r.text) and after[k].n_pieces == len(after[k].ids) for k, r in before.items())


def test_run(spark, states):
    got = P.run(spark, SMALL).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {k: list(r.ids) for k, r in states[0][-1].items()}


def test_edges(spark):
    """Nulls in every column, repeated rows and no rows: every stage runs, and clean rows without an id stay."""
    text = " ".join(f"word{k} des les une the and" for k in range(20))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text + " other end of it all " * 3, None, None, None), (2, None, "en", None, None), (3, "", None, "s", 0), (4, "short one", "en", "s", 9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SMALL}/documents.parquet").select(*P.COLUMNS).schema)
    for some in (docs, docs.where(F.lit(False))):
        for k, (_, stage) in enumerate(P.STAGES):
            some = P.stored(stage(spark, some, SMALL), f"edges{k}")
        some.collect()
