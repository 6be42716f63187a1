"""Full-text and dense retrieval, fusion, and the gate behind them. Everything is by query_id, for many queries at once."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import tokens
from ..lineage import cut, cut_as_dealt

K1, B = 1.2, 0.75
RRF_K = 60
#: Queries asked at once of a part of the rows; rows of a table of asked terms that are sent to all tasks at most.
BLOCK, TOLD = 512, 100_000
#: Rows of one task where a query's rows are added up by key; words of one where hits are counted.
TASK_ROWS, TASK_WORDS = 1_000_000, 500_000
#: Rows and bytes that a task's Python is given at once, in the place of Spark's defaults.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task's Python holds, where the session keeps to Spark's defaults."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, ours)


def told(df: DataFrame) -> DataFrame:
    """df, sent to all tasks if it is small enough for that; else joins shuffle it."""
    return F.broadcast(df) if df.limit(TOLD + 1).count() <= TOLD else df


def _words(rows: DataFrame, weights: dict[str, float], *more: Column) -> DataFrame:
    """(key, more, w, word) of every word in the fields."""
    if len(weights) == 1:
        ((f, w),) = weights.items()
        return rows.select("key", *more, F.lit(float(w)).alias("w"), F.explode(f).alias("word"))
    weighed = lambda w: lambda t: F.struct(F.lit(float(w)).alias("w"), t.alias("word"))
    every = F.concat(*(F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), weighed(w)) for f, w in weights.items()))
    return rows.select("key", *more, F.inline(every))


def phrase_hits(rows: DataFrame, phrases: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(term, key, tf): how often each phrase (term, parts array<string>) stands in each row (key, arrays of words), by
    the weights of its fields; a phrase lies in one field whole.

    Where a phrase may begin is read off its rarest word alone; each place is then looked up for the other words, so a
    frequent word costs no more than the rarest one has places. Repeated words of a phrase count each.
    """
    parts = phrases.select("term", F.size("parts").alias("m"), F.posexplode("parts").alias("i", "word"))
    found = None
    for f, w in weights.items():
        one = rows.select("key", F.lit(f).alias("field"), F.lit(float(w)).alias("w"), F.posexplode(f).alias("pos", "word"))
        found = one if found is None else found.unionByName(one)
    places = cut(found.join(told(parts.select("word").distinct()), "word", "left_semi"))
    often = places.groupBy("word").agg(F.count("*").alias("often"))
    rarest = parts.join(often, "word", "left").groupBy("term", "m").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "i", "word")).alias("x"))
    rarest = rarest.where("x.often > 0").select("term", "m", "x.i", "x.word")
    starts = places.join(told(rarest), "word").where("pos >= i").select("term", "m", F.col("i").alias("seen"), "key", "field", "w", (F.col("pos") - F.col("i")).alias("start"))
    rest = starts.join(told(parts.select("term", "i", "word")), "term").where("i <> seen")
    met = rest.withColumn("pos", F.col("start") + F.col("i")).join(places.drop("w"), ["key", "field", "pos", "word"])
    whole = met.groupBy("term", "key", "field", "start", "m", "w").agg(F.count("*").alias("n")).where("n = m - 1")
    return whole.groupBy("term", "key").agg(F.sum("w").alias("tf"))


def bm25(rows: DataFrame, queries: DataFrame, weights: dict[str, float], forms: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, matched): OR-match of queries (query_id, terms) with rows (key, an array of words for each
    field that weights names).

    A term of several words ("cross-encoder") is a phrase: its words stand one behind the other, and it counts as one
    term with its own frequencies. A term without a word matches nothing. A term's frequency is the weighted sum over
    fields, a row's length all its words. Terms in more than half of the rows count almost nothing. forms (term, form)
    says which words of the rows stand for an asked term; then terms are words. Only asked words are grouped, in one
    shuffle; asked terms and their frequencies go to all tasks where they are few.
    """
    length = sum((F.greatest(F.size(f), F.lit(0)) for f in weights), F.lit(0)).alias("dl")
    sizes = rows.select("key", length).where("dl > 0")
    whole = cut(sizes.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl")))
    asked = queries.select("query_id", F.explode("terms").alias("term")).distinct()
    every = _words(rows, weights, length)
    if forms is None:
        terms = cut(asked.select("term").distinct().withColumn("parts", tokens(F.col("term"))).where(F.size("parts") > 0))
        single = terms.where(F.size("parts") == 1).select("term", F.get("parts", 0).alias("word"))
        phrases = terms.where(F.size("parts") > 1)
    else:
        single, phrases = forms.select(F.col("form").alias("term"), F.col("term").alias("word")), None
    # hits are dealt by key, to as many tasks as the words need, before they are counted: a row's words lie together there, and
    # sums by key stay where the hits are
    n = whole.first()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(n["n_rows"] * (n["avgdl"] or 0) // TASK_WORDS))
    hits = every.join(told(single), "word").select("term", "key", "w", "dl").repartition(parts, "key").groupBy("term", "key").agg(F.sum("w").alias("tf"), F.first("dl").alias("dl"))
    dealt = phrases is None or phrases.isEmpty()
    if not dealt:
        more = phrase_hits(rows, phrases, weights).join(sizes, "key").select("term", "key", "tf", "dl")
        hits = hits.unionByName(more)
    hits = cut_as_dealt(hits)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    df = cut(df)
    # as many tasks as the hits' rows of all queries need
    meets = df.join(asked, "term").agg(F.sum("df")).first()[0] or 0
    if not dealt or meets > 2 * TASK_ROWS * parts:
        hits = hits.repartition(max(parts, -(-meets // TASK_ROWS)), "key")
    # whole is one row
    scored = hits.join(told(df), "term").crossJoin(F.broadcast(whole)).select(
        "term", "key",
        (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).alias("s"),
    )
    return scored.join(told(asked), "term").groupBy("query_id", "key").agg(F.sum("s").alias("score"), F.count("*").alias("matched"))


def ranked(rows: DataFrame, score: str = "score", most: int | None = None, by: str = "query_id", key: str = "key") -> DataFrame:
    """Adds rank from 1 by falling score (6 digits count), ties by key; the first `most` of each query."""
    w = W.partitionBy(by).orderBy(F.desc(F.round(score, 6)), key)
    out = rows.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= most) if most else out


def in_blocks(rows: DataFrame, queries: DataFrame, by: str, most: int = BLOCK) -> DataFrame:
    """Each row with each query. Queries are dealt by a hash of `by` to blocks of about `most`, and every task has one
    block and one part of the rows: nothing is sent to all tasks, whatever the number of queries."""
    queries = queries.repartition(max(1, -(-queries.count() // most)), by)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts).join(queries.hint("shuffle_replicate_nl"))


def _matrices(key: str, vector: str, most: int):
    """Rows in matrices of at most `most`: their keys, in order, and the vectors end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(vector)))
            batch = batch.take(pc.sort_indices(batch.select([key]), [(key, "ascending")]))
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                keys = part.column(key)
                flat = part.column(vector).flatten()
                x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([x.tobytes()], pa.binary())], ["keys", "x"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, most: int = 40, rows: int = 1024) -> DataFrame:
    """(query_id, key, score): dot products of vectors (key, v) with queries (query_id, q), of each part of the vectors the
    `most` best of a query (6 digits count, ties by key), so the best of all are among them.

    Vectors and queries are cut into matrices once, and every task multiplies pairs of them: what meets in a task is
    bounded whatever the number of either, and only the best of a query leave it. A pair holds two matrices, so a task's
    Python is given few pairs at once and holds the products of one. Null vectors match nothing.
    """
    small_batches(vectors.sparkSession)
    types = dict(vectors.dtypes) | dict(queries.dtypes)
    left = cut(vectors.select("key", "v").mapInArrow(_matrices("key", "v", rows), f"keys array<{types['key']}>, x binary"))
    right = cut(queries.select("query_id", "q").mapInArrow(_matrices("query_id", "q", BLOCK), f"keys array<{types['query_id']}>, x binary").select(F.col("keys").alias("asked"), F.col("x").alias("y")))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}  # of each matrix of queries the best so far: rounded scores, keys, scores
        for batch in batches:
            for k in range(batch.num_rows):
                keys, asked = batch.column("keys")[k].values, batch.column("asked")[k].values
                x = np.frombuffer(batch.column("x")[k].as_buffer()).reshape(len(keys), -1)
                scores = np.frombuffer(batch.column("y")[k].as_buffer()).reshape(len(asked), -1) @ x.T
                best = np.argsort(-np.round(scores, 6), axis=1, kind="stable")[:, :most]
                scores, of = np.take_along_axis(scores, best, 1), tuple(asked.to_pylist())
                if not pa.types.is_integer(keys.type):  # keys that numpy doesn't sort: all go on
                    yield rows_of(asked, keys.take(pa.array(best.ravel())), scores)
                    continue
                names = keys.to_numpy()[best]
                if of in found:
                    names, scores = np.hstack([found[of][1], names]), np.hstack([found[of][2], scores])
                    best = np.lexsort((names, -np.round(scores, 6)), axis=1)[:, :most]
                    names, scores = np.take_along_axis(names, best, 1), np.take_along_axis(scores, best, 1)
                found[of] = (pa.array(of, asked.type), names, scores)
        for asked, names, scores in found.values():
            yield rows_of(asked, pa.array(names.ravel()), scores)

    def rows_of(asked: pa.Array, names: pa.Array, scores: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([asked.take(pa.array(np.repeat(np.arange(len(asked)), scores.shape[1]))), names, pa.array(scores.ravel())], ["query_id", "key", "score"])

    # a task has a part of the vectors and about one matrix of queries
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = left.repartition(parts).join(right.repartition(max(1, right.count())).hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(multiply, f"query_id {types['query_id']}, key {types['key']}, score double")


def fuse(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, key, rank): (query_id, key, score, rank, lists).

    A list may hold a key twice; both count. Ties go to the key seen first, list by list. One shuffle.
    """
    every = None
    for no, one in enumerate(lists):
        one = one.select("query_id", "key", F.col("rank").alias("r"), F.lit(no).alias("no"))
        every = one if every is None else every.unionByName(one)
    fused = every.groupBy("query_id", "key").agg(
        F.sum(1 / (k + F.col("r"))).alias("score"), F.min(F.struct("no", "r")).alias("first"), F.array_sort(F.collect_set("no")).alias("lists")
    )
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first.no", "first.r")
    return fused.withColumn("rank", F.row_number().over(w)).drop("first")


def strict_then_loose(scored: DataFrame, n_terms: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """Rows that match all terms; where those are fewer than `least`, the others after them. One pass gives both. The first
    `most` (at least `least`) of each query alone are shuffled: those that match all terms come first, so whether there
    are `least` of them is seen there."""
    rows = scored.join(told(n_terms), "query_id").withColumn("strict", F.col("matched") == F.col("n_terms")).where("strict or n_terms > 1")
    w = W.partitionBy("query_id").orderBy(F.desc("strict"), F.desc(F.round("score", 6)), "key")
    rows = rows.withColumn("rank", F.row_number().over(w))
    if most:
        rows = rows.where(F.col("rank") <= max(most, least))
    rows = rows.withColumn("n_strict", F.count_if(F.col("strict")).over(W.partitionBy("query_id")))
    rows = rows.where(F.col("strict") | (F.col("n_strict") < least))
    return (rows.where(F.col("rank") <= most) if most else rows).drop("n_strict", "n_terms")


def shortlist(fused: DataFrame, lists: list[DataFrame], n: int = 16) -> DataFrame:
    """The first n of the fused list and the first of each list."""
    firsts = None
    for one in lists:
        one = one.where("rank = 1").select("query_id", "key")
        firsts = one if firsts is None else firsts.unionByName(one)
    firsts = firsts.distinct().withColumn("is_first", F.lit(True))
    return fused.join(firsts, ["query_id", "key"], "left").where((F.col("rank") <= n) | F.col("is_first")).drop("is_first")


def blended(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """Adds final = (1 - share) * prob + share * score / best score of the query."""
    top = F.max("score").over(W.partitionBy("query_id"))
    return rows.withColumn("final", (1 - share) * F.col("prob") + share * F.col("score") / top)


def gated(rows: DataFrame, floor: float = 0.05, good_at: float = 0.3) -> DataFrame:
    """(query_id, top, coverage): none below the floor (the answer isn't recorded), thin, or good."""
    top = rows.groupBy("query_id").agg(F.max("prob").alias("top"))
    return top.withColumn("coverage", F.when(F.col("top") < floor, "none").when(F.col("top") >= good_at, "good").otherwise("thin"))


def trimmed(rows: DataFrame, k: int, keep: int = 5, ratio: float = 0.3, least: float = 0.02) -> DataFrame:
    """Walks (query_id, key, final) from the best down: adds pos and cut (kept, bar, stop, limit).

    The bar is `ratio` of the best and at least `least`; the best `keep` pass anyway. The first below the bar
    stops the walk for all after it.
    """
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("final", 6)), "key")
    bar = F.greatest(F.lit(least), ratio * F.max("final").over(W.partitionBy("query_id")))
    rows = rows.withColumn("pos", F.row_number().over(w)).withColumn("bar", bar)
    low = (F.col("final") < F.col("bar")) & (F.col("pos") > keep)
    stopped = F.coalesce(F.max(low).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("cut", F.when(stopped, "stop").when(low, "bar").when(F.col("pos") > k, "limit").otherwise("kept"))
    return rows.drop("bar")


def packed(rows: DataFrame, budget: int, per_note: int, most: int, one_anyway: bool = False) -> DataFrame:
    """Fills a budget in rank order, (query_id, rank, note, size, ...): what doesn't fit is left out and the walk goes
    on; one_anyway takes the first whatever its size. Gives the kept rows.

    A query's candidates are its shortlist, so a fold over them in one row is bounded.
    """
    note = dict(rows.dtypes)["note"]
    cells = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "note", F.col("size").cast("long").alias("size")))).alias("cells"))
    empty = F.array().cast(f"array<struct<rank:int,note:{note},size:bigint>>")

    def step(a: Column, x: Column) -> Column:
        same = F.size(F.filter(a["kept"], lambda y: y["note"] == x["note"]))
        room = a["used"] + x["size"] <= budget
        fits = ((room | (F.size(a["kept"]) == 0)) if one_anyway else room) & (same < per_note) & (F.size(a["kept"]) < most)
        return F.when(
            fits, F.struct((a["used"] + x["size"]).alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))
        ).otherwise(a)

    kept = F.aggregate("cells", F.struct(F.lit(0).cast("long").alias("used"), empty.alias("kept")), step, lambda a: a["kept"])
    return cells.select("query_id", F.inline(kept))


def early_exit(fused: DataFrame, lexical: DataFrame, dense: DataFrame, within: int = 3, few: int = 3, many: int = 16) -> DataFrame:
    """(query_id, early, to_score) of queries that both lists answer: early where they have one first key and it is
    among the first `within` of the fused list."""
    firsts = lexical.where("rank = 1").select("query_id", "key").join(dense.where("rank = 1").select("query_id", F.col("key").alias("other")), "query_id")
    near = fused.where(F.col("rank") <= within).select("query_id", "key", F.lit(True).alias("near"))
    rows = firsts.join(near, ["query_id", "key"], "left")
    early = (F.col("key") == F.col("other")) & F.coalesce("near", F.lit(False))
    return rows.select("query_id", early.alias("early"), F.when(early, few).otherwise(many).alias("to_score"))
