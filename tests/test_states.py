"""Stateful streams against a replay of all events in order."""

import datetime
import random
import tempfile

import pytest

from lodestar.streaming import states

T0 = datetime.datetime(2025, 1, 1, tzinfo=datetime.timezone.utc)


def when(ms):
    return T0 + datetime.timedelta(milliseconds=ms)


def ran(spark, schema, batches, made):
    """What a stream gives for batches of rows, one after another; the last batch moves the watermark on."""
    top = tempfile.mkdtemp(prefix="spark-")
    was = spark.conf.get(states._PROVIDER)
    spark.conf.set(states._PROVIDER, states.ROCKSDB)
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
            out = made(spark.readStream.schema(schema).parquet(f"{top}/in"))
            out.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/check").trigger(availableNow=True).start().awaitTermination(300)
    finally:
        spark.conf.set(states._PROVIDER, was)
    return [r.asDict() for r in spark.read.parquet(f"{top}/out").collect()]


def dealt(rows, end, r):
    """Rows in three batches, out of order by less than the lateness; a restart of the query between them."""
    rows = sorted(rows, key=lambda e: (e[1] + datetime.timedelta(milliseconds=r.randrange(900)), e[2]))
    third = len(rows) // 3
    return [rows[:third], rows[third : 2 * third], rows[2 * third :], end]


def test_rotation(spark):
    r = random.Random(4)
    families, rows, number = {}, [], 0
    for f in "abcdef":
        at, tokens = r.randrange(1000), [f"{f}0"]
        events = [(at, number, "issue", f"{f}0", None)]
        for k in range(1, 14):
            at += r.choice([0, 10, 400, 1500, 4000 if f == "c" else 30])
            number += 1
            token = r.choice([tokens[-1]] * 8 + tokens[:1] + ["strange"])
            events.append((at, number, "refresh", token, f"{f}{k}"))
            tokens.append(f"{f}{k}")
        number += 1
        families[f] = events
        rows += [(f, when(t), n, kind, token, other) for t, n, kind, token, other in events]
    schema = "family string, at timestamp, number long, kind string, token string, other string"
    end = [("end", when(10**7), 10**6, "issue", "x", None)]
    got = ran(spark, schema, dealt(rows, end, r), lambda feed: states.rotations(feed, 3000, "10 seconds"))
    want = [(f, x["number"], x["token"], x["outcome"]) for f, events in families.items() for x in states.replayed(states.Rotation(3000), events)]
    assert sorted((x["family"], x["number"], x["token"], x["outcome"]) for x in got if x["family"] != "end") == sorted(want)
    assert {w[3] for w in want} >= {"issued", "rotated", "reused", "unknown"}


def test_rules():
    rule = states.Rotation(100)
    said = lambda events: [x["outcome"] for x in states.replayed(rule, events)]
    issue = (0, 0, "issue", "a", None)
    assert said([issue, (50, 1, "refresh", "a", "b"), (60, 2, "refresh", "a", "c"), (70, 3, "refresh", "b", "d")]) == ["issued", "rotated", "reused", "reused"]
    assert said([issue, (90, 1, "refresh", "a", "b"), (200, 2, "refresh", "b", "c"), (201, 3, "refresh", "b", "c")]) == ["issued", "rotated", "unknown", "unknown"]  # all expired: forgotten
    assert said([issue, (1, 1, "issue", "z", None), (50, 2, "refresh", "z", "y"), (102, 3, "refresh", "z", "q"), (103, 4, "issue", "n", None)]) == ["issued", "issued", "rotated", "reused", "refused"]
    work = states.Quiet(10, 5)
    begun = lambda events: [(x["at"], x["changes"]) for x in states.replayed(work, events)]
    assert begun([(0, 0, "change"), (5, 1, "change"), (14, 2, "change")]) == [(24, 3)]  # each change starts the wait anew
    assert begun([(0, 0, "change"), (12, 1, "change"), (30, 2, "change"), (40, 3, "done"), (60, 4, "done")]) == [(10, 1), (45, 2)]
    assert begun([(0, 0, "change"), (50, 1, "done"), (51, 2, "done")]) == [(10, 1)]


def test_quiet_work(spark):
    r = random.Random(9)
    keys, rows, number = {}, [], 0
    for k in "pqrs":
        at, events = r.randrange(500), []
        for _ in range(25):
            at += r.choice([20, 100, 700, 2500])
            number += 1
            events.append((at, number, r.choice(["change", "change", "change", "done"])))
        keys[k] = events
        rows += [(k, when(t), n, kind) for t, n, kind in events]
    end = [("end", when(10**7), 10**6, "done")]
    got = ran(spark, "key string, at timestamp, number long, kind string", dealt(rows, end, r), lambda feed: states.quiet_work(feed, 300, 500, "10 seconds"))
    ms = lambda t: round((t.replace(tzinfo=datetime.timezone.utc) - T0).total_seconds() * 1000)
    want = [(k, x["at"], x["changes"], x["first"], x["last"]) for k, events in keys.items() for x in states.replayed(states.Quiet(300, 500), events)]
    assert sorted((x["key"], ms(x["at"]), x["changes"], ms(x["first"]), ms(x["last"])) for x in got) == sorted(want)
    for k, events in keys.items():  # no change is lost or worked on twice
        assert sum(w[2] for w in want if w[0] == k) <= sum(e[2] == "change" for e in events)


def test_needs_its_state_store(spark):
    feed = spark.readStream.format("rate").load().selectExpr("'k' as key", "timestamp as at", "value as number", "'change' as kind")
    with pytest.raises(ValueError, match="providerClass"):
        states.quiet_work(feed, 1, 1, "1 second")
