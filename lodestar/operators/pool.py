"""From ranked lists to an answer: linked sections get places beside listed ones, and two judges decide what stays.

All is by query_id, for many questions at once. A question's candidates are one relation with where each came from
(`src`): the head of the fused list, firsts of single lists, and sections that the notes of the best hits link to
("graph"). The first judge sees list rows only: whether there is an answer at all, how low a row may score, how many
are kept anyway, when the walk ends. Graph rows then pass on their own merit, and raise nothing for the others. Last, a
trimmed list row that is linked with a kept one is kept after all.

Relations: a list is (query_id, key, note, rank); fused (query_id, key, note, score, rank); neighbours (id, nb, strength,
dir) as graph.neighbours() gives them; windows (query_id, note, key, cos), the sections' closeness to the question.
Candidates of a question are bounded by the settings, so windows by query_id are small.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import graph as G

# First places that no link takes, first entries of a list that stay, the rank in both kinds of list that
# protects, what a second seed adds.
TOP_FIXED, PROTECT_TOP, PROTECT_BOTH, SHARED = 3, 3, 10, 0.5


def _top(fused: DataFrame) -> Column:
    return F.max("score").over(W.partitionBy("query_id"))


def seeds(fused: DataFrame, n: int) -> DataFrame:
    """(query_id, note, key, score, place): the notes of the first n fused rows, with the share of the best score."""
    rows = fused.withColumn("share", F.col("score") / _top(fused)).where(F.col("rank") <= n)
    return rows.groupBy("query_id", "note").agg(F.min_by(F.struct("key", F.col("share").alias("score"), F.col("rank").alias("place")), "rank").alias("x")).select("query_id", "note", "x.*")


def reached(seeds: DataFrame, neighbours: DataFrame, listed: DataFrame, least: float) -> DataFrame:
    """(query_id, note, seed, share, place, strength, dir): the notes that links of the seeds, `least` strong, lead to
    and that aren't listed (query_id, note)."""
    links = neighbours.where(F.col("strength") >= least).select(F.col("id").alias("seed"), F.col("nb").alias("note"), "strength", "dir")
    rows = seeds.select("query_id", F.col("note").alias("seed"), F.col("score").alias("share"), "place").join(links, "seed")
    return rows.join(listed.select("query_id", "note").distinct(), ["query_id", "note"], "left_anti")


def closeness(pairs: DataFrame, sections: DataFrame, asked: DataFrame) -> DataFrame:
    """windows (query_id, note, key, cos) of some pairs (query_id, note): products of the vectors of the notes' sections
    (note, key, v) with the questions' (query_id, q). Only these pairs are computed."""
    rows = pairs.select("query_id", "note").distinct().join(sections, "note").join(asked, "query_id")
    cos = F.aggregate(F.zip_with("v", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return rows.select("query_id", "note", "key", cos.alias("cos")).where("cos is not null")


def linked(reached: DataFrame, windows: DataFrame, each: int, most: int) -> DataFrame:
    """(query_id, note, key, seed, dir, strength, fit, score, pick): the sections that links lead to, best first.

    A note counts with its window closest to the question, and not without one; score is the seed's times the link's
    times the closeness, and half as much again for each further seed that reaches the note. Each seed keeps its `each`
    best, a question `most`.
    """
    best = windows.join(reached.select("query_id", "note").distinct(), ["query_id", "note"], "left_semi").groupBy("query_id", "note").agg(F.min_by(F.struct("key", "cos"), F.struct(F.negative("cos"), "key")).alias("w"))
    rows = reached.join(best, ["query_id", "note"]).withColumn("key", F.col("w.key")).withColumn("fit", F.greatest(F.lit(0.0), F.col("w.cos")))
    rows = rows.withColumn("s", F.round(F.col("share") * F.col("strength") * F.col("fit"), 12))
    kept = rows.withColumn("k", F.row_number().over(W.partitionBy("query_id", "seed").orderBy(F.desc("s"), "key"))).where(F.col("k") <= each)
    one = kept.groupBy("query_id", "note").agg(F.max_by(F.struct("key", "seed", "dir", "strength", "fit", "s"), F.struct("s", F.negative("place"))).alias("x"), F.count("*").alias("n"))
    one = one.select("query_id", "note", "x.*", (F.col("x.s") * (1 + SHARED * (F.col("n") - 1))).alias("score"))
    return one.withColumn("pick", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("pick") <= most).drop("s")


def protected(lists: dict[str, DataFrame], seeds: DataFrame, keyword: tuple[str, ...] = ("lex", "note"), meaning: str = "den", whole: tuple[str, ...] = ("exact",)) -> DataFrame:
    """(query_id, key) that links don't displace: seeds, the first entries of each list, lists that count whole, and what
    a keyword list and the list by meaning both have high up."""
    out = seeds.select("query_id", "key")
    for name, rows in lists.items():
        out = out.union((rows if name in whole else rows.where(F.col("rank") <= PROTECT_TOP)).select("query_id", "key"))
    high = lambda rows: rows.where(F.col("rank") <= PROTECT_BOTH).select("query_id", "key")
    words = None
    for name in keyword:
        if name in lists:
            words = high(lists[name]) if words is None else words.union(high(lists[name]))
    if words is not None and meaning in lists:
        out = out.union(words.join(high(lists[meaning]), ["query_id", "key"], "left_semi"))
    return out.distinct()


def candidates(fused: DataFrame, lists: dict[str, DataFrame], picks: DataFrame | None, protect: DataFrame | None, head: int = 16, weight: float = 1.0) -> DataFrame:
    """(query_id, key, note, src, fused_rank, share, agree, seed, dir, strength, fit, i): the pool in its order.

    The head of the fused list, then each list's first where the head hasn't it, then picks that took places. Picks, best
    first, take the places of the weakest unprotected rows of the head below the first three, one for one, until one
    isn't better (weight times its score against the row's share of the best). A question whose keyword list and list by
    meaning agree on the first key, with that among the first three, takes no picks (agree).
    """
    fused = fused.withColumn("share", F.col("score") / _top(fused))
    top = fused.where(F.col("rank") <= head).select("query_id", "key", "note", F.lit("head").alias("src"), "rank", "share", F.lit(0).alias("list"))
    pool = top
    for no, rows in enumerate(lists.values(), 1):
        pool = pool.union(rows.where("rank = 1").select("query_id", "key", "note", F.lit("first").alias("src"), F.lit(None).cast("int").alias("rank"), F.lit(0.0).alias("share"), F.lit(no).alias("list")))
    pool = pool.groupBy("query_id", "key", "note").agg(F.min_by("src", "list").alias("src"), F.min("list").alias("list"))
    pool = pool.join(fused.select("query_id", "key", F.col("rank").cast("int").alias("fused_rank"), "share"), ["query_id", "key"])
    first = [rows.where("rank = 1").select("query_id", "key") for name, rows in lists.items() if name in ("lex", "den")]
    agreed = first[0].join(first[1], ["query_id", "key"]).join(fused.where("rank <= 3").select("query_id", "key"), ["query_id", "key"], "left_semi") if len(first) == 2 else fused.limit(0).select("query_id", "key")
    agreed = agreed.select("query_id", F.lit(True).alias("agree"))
    pool = pool.join(agreed, "query_id", "left").withColumn("agree", F.coalesce("agree", F.lit(False)))
    graph = {"seed": "string", "dir": "string", "strength": "double", "fit": "double"}
    if picks is not None:
        graph["seed"] = dict(picks.dtypes)["seed"]
        open_ = picks.join(agreed, "query_id", "left_anti")
        swap = G.fair_swap(
            pool.where("src = 'head'").select("query_id", "key", F.col("fused_rank").alias("rank"), F.col("share").alias("fit")),
            open_.select("query_id", "key", (weight * F.col("score")).alias("fit")), protect, TOP_FIXED,
        )
        took = open_.join(swap.select("query_id", F.col("into").alias("key")), ["query_id", "key"])
        took = took.join(fused.select("query_id", "key", F.col("rank").cast("int").alias("fused_rank"), "share"), ["query_id", "key"], "left")
        took = took.select(
            "query_id", "key", "note", F.lit("graph").alias("src"), F.lit(1 << 20).alias("list"), "fused_rank", F.coalesce("share", F.lit(0.0)).alias("share"), F.lit(False).alias("agree"), "seed", "dir", "strength", "fit", "pick"
        )
        pool = pool.join(swap.select("query_id", F.col("out").alias("key")), ["query_id", "key"], "left_anti").select(
            "query_id", "key", "note", "src", "list", "fused_rank", "share", "agree", *(F.lit(None).cast(t).alias(c) for c, t in graph.items()), F.lit(None).cast("int").alias("pick")
        ).union(took)
    else:
        pool = pool.select("*", *(F.lit(None).cast(t).alias(c) for c, t in graph.items()), F.lit(None).cast("int").alias("pick"))
    order = W.partitionBy("query_id").orderBy("list", F.coalesce("pick", "fused_rank"), "key")
    return pool.withColumn("i", F.row_number().over(order)).drop("list", "pick")


def scored(pool: DataFrame, probs: DataFrame, few: int = 3, blend: float = 0.2) -> DataFrame:
    """candidates() with prob, reranked and score. probs (query_id, key, prob) are a scorer's, 0 where it has none. Where
    lists agree only the first `few` count; the rest have nine tenths of the least of these, by their fused share."""
    rows = pool.join(probs, ["query_id", "key"], "left").withColumn("p", F.coalesce("prob", F.lit(0.0)))
    rows = rows.withColumn("reranked", ~F.col("agree") | (F.col("i") <= few))
    low = F.min(F.when(F.col("i") <= few, F.col("p"))).over(W.partitionBy("query_id"))
    rows = rows.withColumn("prob", F.when(F.col("reranked"), F.col("p")).otherwise(0.9 * low * F.col("share"))).drop("p")
    return rows.withColumn("score", (1 - blend) * F.col("prob") + blend * F.col("share"))


def judged(rows: DataFrame, k: int, keep: int = 5, ratio: float = 0.3, floor: float = 0.05, good_at: float = 0.3, least: float = 0.02) -> DataFrame:
    """scored() with place, coverage (none, thin, good) and cut: kept, floor, trim or limit.

    List rows alone set the best probability that coverage goes by, and the bar: `ratio` of the best score, `least` at
    least. Best first, list rows are kept until one below the bar comes after the best `keep`, or k are kept; that ends
    it for all behind. A graph row before that is kept if its probability reaches the floor, its score the bar, and there
    is room; it neither ends the walk nor counts among the best `keep`. Without an answer all are cut by the floor.
    """
    q = W.partitionBy("query_id")
    graph = F.col("src") == "graph"
    rows = rows.withColumn("_top", F.max(F.when(~graph & F.col("reranked"), F.col("prob"))).over(q)).withColumn("_bar", F.greatest(F.lit(least), ratio * F.max(F.when(~graph, F.col("score"))).over(q)))
    order = q.orderBy(F.desc(F.round("score", 12)), "i")
    rows = rows.withColumn("place", F.row_number().over(order))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    low = F.col("score") < F.col("_bar")
    fits = ~graph | ((F.col("prob") >= floor) & ~low)
    rows = rows.withColumn("_base", F.coalesce(F.count_if(~graph).over(before), F.lit(0))).withColumn("_out", F.coalesce(F.count_if(fits).over(before), F.lit(0)))
    stop = F.when(~graph & (F.col("_base") >= keep) & low, "trim").when(~graph & (F.col("_out") >= k), "limit")
    rows = rows.withColumn("_stop", F.first(stop, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = F.when(graph & (F.col("prob") < floor), "floor").when(graph & low, "trim").when(F.col("_out") >= k, "limit")
    none = F.col("_top") < floor
    rows = rows.withColumn("cut", F.when(none, "floor").otherwise(F.coalesce("_stop", own, F.lit("kept"))))
    coverage = F.when(none, "none").when(F.col("_top") >= good_at, "good").otherwise("thin")
    return rows.withColumn("coverage", coverage).drop("_top", "_bar", "_base", "_out", "_stop")


def partners(rows: DataFrame, neighbours: DataFrame, k: int, most: int = 1, least: float = 0.1) -> DataFrame:
    """judged() with `partner`: the kept note that a trimmed list row is kept for after all (cut is kept then).

    Only where the bar ended the walk and there is room, and lists didn't agree; rows that were scored, of notes that
    aren't kept, linked with a kept one by at least `least`: at most `most` for a question, in the order of score, each
    note once. The strongest link tells (the earlier kept note on a tie).
    """
    q = W.partitionBy("query_id")
    kept = F.col("cut") == "kept"
    n = F.count_if(kept).over(q)
    ended = F.max(~F.col("agree") & (F.col("src") != "graph") & (F.col("cut") == "trim")).over(q)
    rows = rows.withColumn("_room", F.when(ended, F.least(F.lit(most), k - n)).otherwise(0))
    anchors = rows.where(kept).groupBy("query_id", F.col("note").alias("anchor")).agg(F.min("place").alias("at"))
    links = neighbours.where(F.col("strength") >= least).select(F.col("id").alias("anchor"), F.col("nb").alias("note"), F.col("strength").alias("link"))
    wanted = rows.where("cut = 'trim' and src <> 'graph' and reranked and _room > 0").join(anchors.select("query_id", F.col("anchor").alias("note")), ["query_id", "note"], "left_anti")
    found = wanted.join(anchors, "query_id").join(links, ["anchor", "note"]).groupBy("query_id", "key", "note", "place", "_room").agg(F.max_by("anchor", F.struct("link", F.negative("at"))).alias("partner"))
    one = found.groupBy("query_id", "note", "_room").agg(F.min_by(F.struct("key", "partner", "place"), "place").alias("x")).select("query_id", "note", "_room", "x.*")
    one = one.withColumn("k", F.row_number().over(q.orderBy("place"))).where("k <= _room").select("query_id", "key", "partner")
    out = rows.drop("_room").join(one, ["query_id", "key"], "left")
    return out.withColumn("cut", F.when(F.col("partner").isNotNull(), "kept").otherwise(F.col("cut")))


def traced(rows: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """rows with a column for each list: the row's rank there, null where it isn't."""
    for name, one in lists.items():
        rows = rows.join(one.groupBy("query_id", "key").agg(F.min("rank").cast("int").alias(name)), ["query_id", "key"], "left")
    return rows
