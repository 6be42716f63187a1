"""Change feeds, merges, sessions and audit logs; the same expressions serve batches and streams."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Parts that a group is dealt to before its best rows are chosen.
SALTS = 16


def top_of(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, numbered (no). A group is first cut to n rows in each of SALTS parts, so that
    one hot group isn't sorted by one task."""
    first = W.partitionBy(*by, "_part").orderBy(*order)
    some = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).withColumn("no", F.row_number().over(first)).where(F.col("no") <= n)
    return some.drop("_part").withColumn("no", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("no") <= n)


def latest(feed: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by its number; taken in each task first."""
    rest = [c for c in feed.columns if c not in (key, seq)]
    last = feed.groupBy(key).agg(F.max(seq).alias(seq), *(F.max_by(c, seq).alias(c) for c in rest))
    return last.select(*feed.columns)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key; both have the same columns."""
    return old.join(new, key, "left_anti").unionByName(new)


def sessions(events: DataFrame, at: str, by: list[str], gap: str) -> DataFrame:
    """(by, start, last, n): events of a key less than the gap apart are one session."""
    one = events.groupBy(*by, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count("*").alias("n"))
    return one.drop("w")


def audit(calls: DataFrame, failed_below: float = 10) -> DataFrame:
    """Calls, failures and mean latency of each tool and day; calls (ts, event_type, value)."""
    return calls.groupBy(F.col("event_type").alias("tool"), F.date_trunc("day", "ts").alias("day")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("value") < failed_below).alias("failed"), F.round(F.avg("value"), 6).alias("mean")
    )


def alive(rows: DataFrame, at: Column, kind: str = "event_type", since: str = "ts") -> DataFrame:
    """Rows whose time to live isn't over: a week for purchases, 30 days for refunds, an hour for the rest."""
    hours = F.when(F.col(kind) == "purchase", 7 * 24).when(F.col(kind) == "refund", 30 * 24).otherwise(1)
    return rows.where(F.col(since) + F.make_interval(hours=hours) > at)


def to_embed(sections: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """(id, ord, input, hash) of sections (id, ord, input) whose vector (id, ord, hash, model) is missing, of another
    text or of another model."""
    asked = sections.select("id", "ord", "input", F.sha1("input").alias("hash"))
    have = vectors.select("id", "ord", F.col("hash").alias("had"), F.col("model").alias("by"))
    rows = asked.join(have, ["id", "ord"], "left")
    return rows.where(F.col("had").isNull() | (F.col("had") != F.col("hash")) | (F.col("by") != model)).select("id", "ord", "input", "hash")


def orphans(vectors: DataFrame, sections: DataFrame) -> DataFrame:
    """Vectors (id, ord) beyond their note's last section, or of notes that are gone."""
    n = sections.groupBy("id").agg(F.count("*").alias("n"))
    return vectors.join(n, "id", "left").where(F.col("ord") >= F.coalesce("n", F.lit(0))).select(*vectors.columns)


def recent_failures(attempts: DataFrame, by: str, now: Column, window: Column) -> DataFrame:
    """(by, n): failures of attempts (by, ts, ok) within the window before now, and after the last success."""
    last = F.max(F.when(F.col("ok"), F.col("ts"))).over(W.partitionBy(by))
    rows = attempts.withColumn("last", last).where(~F.col("ok") & (F.col("ts") <= now) & (F.col("ts") > now - window) & (F.col("last").isNull() | (F.col("ts") > F.col("last"))))
    return rows.groupBy(by).agg(F.count("*").alias("n"))
