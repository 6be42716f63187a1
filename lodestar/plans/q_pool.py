"""The whole ranker with linked sections, and its trace. Documents are notes of one section; each links to two others."""

from pyspark.sql import functions as F

from ..functions.text import first_tokens, tokens
from ..lineage import cut
from ..operators import graph as G
from ..operators import pool as P
from ..operators import retrieval as R
from ..registry import query
from .q_retrieval import TEXT, words
from .views import questions, table


def doc_neighbours(spark, d):
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))  # one number
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("a")).crossJoin(F.broadcast(n))
    to = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("sentence").alias("kind"), ((F.col("a") * 7 + 3) % F.col("n")).alias("b")), F.struct(F.lit(1).alias("pos"), F.lit("list_bare").alias("kind"), ((F.col("a") * 13 + 5) % F.col("n")).alias("b"))
    )
    edges = docs.select("a", F.inline(to)).withColumn("fm_key", F.lit(None).cast("string"))
    return G.neighbours(G.strengths(G.pairs(G.weighted(edges))))


def vectors(spark, d):
    """(sections, asked): the vector of each note, and of each question that of one of them."""
    v = table(spark, d, "embeddings")
    n = v.agg(F.count("*").alias("n"))
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).crossJoin(F.broadcast(n)).withColumn("vec_id", F.col("query_id") * 20 % F.col("n"))
    return v.select(F.col("vec_id").alias("note"), F.col("vec_id").alias("key"), F.col("embedding").alias("v")), q.join(v, "vec_id").select("query_id", F.col("embedding").alias("q"))


def titled(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), first_tokens(F.col("text"), 3).alias("title"))


def ranked_pool(spark, d, k=8):
    """(the pool with all that became of it, the lists, the fused list)."""
    asked = questions(spark, d)
    sections, q = vectors(spark, d)
    as_list = lambda rows: rows.select("query_id", "key", F.col("key").alias("note"), F.col("rank").cast("int").alias("rank"))
    lists = {
        "lex": R.ranked(R.bm25(words(spark, d), asked, TEXT), most=40),
        "den": R.ranked(R.dense(sections.select("key", "v"), q, 40), most=40),
        "title": R.ranked(R.bm25(titled(spark, d), asked, {"title": 1.0}), most=15),
    }
    lists = {name: cut(as_list(rows)) for name, rows in lists.items()}
    fused = R.fuse(list(lists.values()))
    fused = cut(fused.select("query_id", "key", F.col("key").alias("note"), "score", F.col("rank").cast("int").alias("rank")))
    links = cut(doc_neighbours(spark, d))
    seeds = P.seeds(fused, 5)
    listed = P.candidates(fused, lists, None, None)
    near = P.reached(seeds, links, listed, 0.2)
    picks = P.linked(near, P.closeness(near, sections, q), 3, 10)
    pool = cut(P.candidates(fused, lists, picks, P.protected(lists, seeds, ("lex", "title")), weight=10.0))
    # what a text holds of the question's terms; only texts of the pool are read
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text").join(pool.select("key").distinct(), "key", "left_semi")
    held = pool.select("query_id", "key").join(texts.select("key", F.array_distinct(tokens(F.col("text"))).alias("has")), "key").join(asked, "query_id")
    probs = held.select("query_id", "key", (F.size(F.array_intersect("has", "terms")) / F.greatest(F.size("terms"), F.lit(1))).alias("prob"))
    rows = P.partners(P.judged(P.scored(pool, probs), k), links, k)
    return P.traced(rows, lists), lists, fused


@query()
def rank_trace(spark, d):
    """Every candidate of every question: where it came from, its place in each list, the fused one and the answer, its
    probability and score, what cut it, and which links brought or saved it."""
    rows, _, _ = ranked_pool(spark, d)
    round_ = lambda c: F.round(c, 6).alias(c)
    return rows.select("query_id", "key", "src", "lex", "den", "title", "fused_rank", "place", "cut", "coverage", "agree", round_("prob"), round_("score"), F.col("seed").cast("string").alias("seed"), "dir", F.col("partner").cast("string").alias("partner"))


@query()
def rank_funnel(spark, d):
    """Of each question how many rows were in any list, in the pool by where they came from, and what became of them."""
    rows, lists, fused = ranked_pool(spark, d)
    every = fused.groupBy("query_id").agg(F.count("*").alias("fused"))
    count = lambda what, name: F.count_if(what).alias(name)
    stages = rows.groupBy("query_id").agg(
        F.count("*").alias("pool"), *(count(F.col("src") == x, x) for x in ("head", "first", "graph")), count(F.col("reranked"), "reranked"), *(count(F.col("cut") == x, x) for x in ("kept", "floor", "trim", "limit")),
        count(F.col("partner").isNotNull(), "partners"), F.first("coverage").alias("coverage"),
    )
    return every.join(stages, "query_id")
