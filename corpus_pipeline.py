"""A training corpus from raw documents: each stage works on all that the one before has kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. What a
stage returned has to be written before the next stage begins, which deletes the files that the stage before left.
"""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard, language, pieces, substrings
from lodestar.llm.common import discard, held, release, small_batches, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the last stage has written and its result reads.
_left: list[str] = []


def stage(work: Stage) -> Stage:
    """Frees the files of the stage before, so that a run takes the disk of its largest stage and not of all."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        release(spark, _left)
        _left.clear()
        before = set(held)
        got = work(spark, docs, sf_dir)
        _left.extend(x for x in held if x not in before)
        return got

    return run_stage


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter go. Where no language could be learned, all others stay."""
    model = language.Model(*language.sample(docs))
    if not model.langs:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    got = language.identified(docs, [c for c in docs.columns if c != "text"], model)
    return got.where("lang_pred <> 'und'").select(*docs.columns)


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest doc_id. Documents without n-grams are no copies, and rows
    without doc_id stay."""
    others = jaccard.similar_groups(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


@stage
def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out, and n_chars follows. Texts without any stay as they are; a document of which
    nothing is left goes."""
    more = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    got = substrings.without_repeats(docs, more).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return got.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@stage
def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items. Null texts and rows without doc_id have no hits and stay."""
    bad = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


@stage
def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids) of each document; a null text has null ids and n_pieces."""
    got = pieces.encoded(docs, ["doc_id", "lang", "source"])
    return got.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", no_repeats),
    ("benchmark decontamination", no_benchmarks),
    ("SentencePiece encoding", as_pieces),
]

#: Two stages learn or encode by models, which SQL can't express; run() is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, work) in enumerate(STAGES):
        got = stored(work(spark, docs, sf_dir), f"stage{k}")
        if k:
            discard(docs)
        docs = got
    return docs
