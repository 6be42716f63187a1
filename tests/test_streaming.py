"""Streams give what batches give."""

import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from lodestar.operators.changes import audit, latest
from lodestar.streaming import feeds


def test_keep_current(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(4).write.parquet(f"{top}/in")
    feed = feeds.read_feed(spark, f"{top}/in", events.schema)
    for _ in range(2):  # the second run finds nothing new
        feeds.keep_current(feed, "user_id", "event_id", f"{top}/state", f"{top}/checkpoint").awaitTermination(120)
    got = feeds.current(spark, f"{top}/state", "user_id", "event_id")
    want = latest(events, "user_id", "event_id")
    feeds.compact(spark, f"{top}/state", "user_id", "event_id")  # one batch: nothing to do
    events.limit(50).withColumn("event_id", F.col("event_id") + 10**6).write.mode("append").parquet(f"{top}/in")
    feeds.keep_current(feed, "user_id", "event_id", f"{top}/state", f"{top}/checkpoint").awaitTermination(120)
    want = latest(spark.read.parquet(f"{top}/in"), "user_id", "event_id")
    for _ in range(2):
        got = feeds.current(spark, f"{top}/state", "user_id", "event_id")
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
        feeds.compact(spark, f"{top}/state", "user_id", "event_id")
    import os

    assert len([x for x in os.listdir(f"{top}/state") if x.startswith("batch=")]) == 1
    gone = feeds.current(spark.newSession(), f"{top}/state", "user_id", "event_id")
    assert gone.count() == want.count()
    got = feeds.current(spark, f"{top}/state", "user_id", "event_id")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_audit_stream(spark):
    top = tempfile.mkdtemp(prefix="spark-")
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{top}/in")
    rows = feeds.audit_stream(feeds.read_feed(spark, f"{top}/in", events.schema))
    rows.writeStream.outputMode("complete").format("memory").queryName("audited").trigger(availableNow=True).start().awaitTermination(120)
    got = spark.table("audited").collect()
    want = audit(events).drop("mean").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
