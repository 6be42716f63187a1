"""Counts against the library itself."""

import pytest

from lodestar.llm import token_counts as T


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.vocabulary_path())


def want(library, rows):
    return sorted((k, len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for k, x in rows)


CASES = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "It's  the end\n\n of 2024 lines\t"), (6, "x<|endoftext|>y <|endoftext|>"),
    (7, "naïve café – 東京 🙂🙂 ½ ²"), (8, "word " * 50_000), (8, "a"), (9, "z" * 5000), (10, "\U0001e4d0Ᲊ new letters"),
]


def test_edges(spark, library):
    df = spark.createDataFrame([(k, x, 7, "c") for k, x in CASES], "doc_id long, text string, n_tokens long, block string")
    got = T.token_counts(df)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    assert sorted(map(tuple, got.collect())) == want(library, CASES)
    assert T.token_counts(df.limit(0)).collect() == []


def test_many_blocks(spark, library):
    """A block for each partition at least."""
    rows = [(k, f"the {k} and the {k % 7} of {'abc' * (k % 5)}") for k in range(300)]
    got = T.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(map(tuple, got.collect())) == want(library, rows)


def test_query(spark, library):
    got = T.op10_token_counts(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want(library, rows)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
