"""Streams with state of their own: rotating tokens by family, and work that waits for quiet and runs once at a time.

Events may come out of order within the watermark. Each key keeps what has come until the watermark has passed it, and
takes it then in order of time and number; so what comes out is what a replay of all events in order gives. Timers
end waiting and free what a key no longer needs. State lives in Spark's RocksDB state store, which these operators need:
set spark.sql.streaming.stateStore.providerClass to ROCKSDB for the session.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Rotation:
    """A family of refresh tokens. Events: issue (token starts the family), refresh (token is given for `other`)."""

    columns, output = ("kind", "token", "other"), "at timestamp, number long, token string, outcome string"

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def fresh(self) -> dict:
        return {"tokens": {}, "revoked": False}

    def ends(self, s: dict) -> int | None:
        """When the last token expires; the family is forgotten then."""
        return max((t[0] for t in s["tokens"].values()), default=None)

    def due(self, s: dict) -> int | None:
        return None

    def step(self, s: dict, at: int, number: int, event: dict) -> list[dict]:
        end = self.ends(s)
        if end is not None and at > end:
            s.update(self.fresh())
        tokens, token, row = s["tokens"], event["token"], {"at": at, "number": number, "token": event["token"]}
        if event["kind"] == "issue":
            if s["revoked"] or token in tokens:
                return [row | {"outcome": "refused"}]
            tokens[token] = [at + self.ttl, False]
            return [row | {"outcome": "issued"}]
        if token not in tokens:
            return [row | {"outcome": "unknown"}]
        if tokens[token][1]:
            # given twice, so it has leaked: nothing of the family holds any more
            for t in tokens.values():
                t[1] = True
            s["revoked"] = True
            return [row | {"outcome": "reused"}]
        if tokens[token][0] < at:
            return [row | {"outcome": "expired"}]
        tokens[token][1] = True
        tokens[event["other"]] = [at + self.ttl, False]
        return [row | {"outcome": "rotated"}]


class Quiet:
    """Work on a key. Events: change (work is needed), done (it has ended). Work begins when no change has come for
    `delay`; changes while it runs make it run again, `again` after it ended."""

    columns, output = ("kind",), "at timestamp, changes long, first timestamp, last timestamp"

    def __init__(self, delay_ms: int, again_ms: int):
        self.delay, self.again = delay_ms, again_ms

    def fresh(self) -> dict:
        return {"n": 0, "first": None, "last": None, "due": None, "running": False}

    def ends(self, s: dict) -> int | None:
        return None

    def due(self, s: dict) -> int | None:
        return s["due"]

    def fire(self, s: dict) -> list[dict]:
        row = {"at": s["due"], "changes": s["n"], "first": s["first"], "last": s["last"]}
        s.update(self.fresh() | {"running": True})
        return [row]

    def step(self, s: dict, at: int, number: int, event: dict) -> list[dict]:
        if event["kind"] == "done":
            s["running"] = False
            if s["n"]:
                s["due"] = at + self.again
            return []
        s["n"], s["first"], s["last"] = s["n"] + 1, at if s["first"] is None else s["first"], at
        if not s["running"]:
            s["due"] = at + self.delay
        return []


def replayed(rule, events: list[tuple]) -> list[dict]:
    """What a rule gives for the events (at in ms, number, values of its columns) of one key, all of them, in order;
    what is due at the end comes too."""
    s, out = rule.fresh(), []
    for at, number, *values in sorted(events, key=lambda e: e[:2]):
        if (due := rule.due(s)) is not None and due <= at:
            out += rule.fire(s)
        out += rule.step(s, at, number, dict(zip(rule.columns, values)))
    return out + (rule.fire(s) if rule.due(s) is not None else [])


class _InOrder(StatefulProcessor):
    def __init__(self, rule, key: str):
        self.rule, self.key = rule, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, number long, event string")
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for part in rows:
            at = part["at"].astype("datetime64[ms]").astype("int64")
            new += [(int(t), int(n), json.dumps(e)) for t, n, e in zip(at, part["number"], part[list(self.rule.columns)].to_dict("records"))]
        if new:
            self.waiting.appendList(new)
            for at in {e[0] for e in new}:
                self.handle.registerTimer(at)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        s = json.loads(self.state.get()[0]) if self.state.exists() else self.rule.fresh()
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [e for e in events if e[0] <= until]
        out = []
        for at, number, event in ready:
            if (due := self.rule.due(s)) is not None and due <= at:
                out += self.rule.fire(s)
            out += self.rule.step(s, at, number, json.loads(event))
        due = self.rule.due(s)
        # an event of that very time may still come while the watermark hasn't passed it
        if due is not None and due < until:
            out += self.rule.fire(s)
            due = None
        if ready:
            rest = events[len(ready) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
        end = self.rule.ends(s)
        if end is not None and end < until and len(ready) == len(events):
            self.state.clear()
        else:
            self.state.update((json.dumps(s),))
            for at in (due, end):
                if at is not None:
                    self.handle.registerTimer(max(at, until) + 1)
        if out:
            rows = pd.DataFrame(out)
            for c in ("at", "first", "last"):
                if c in rows:
                    rows[c] = pd.to_datetime(rows[c], unit="ms")
            rows.insert(0, self.key, key[0])
            yield rows
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def in_order(feed: DataFrame, rule, key: str, late: str) -> DataFrame:
    """What a rule gives for a stream (key string, at timestamp, number long, the rule's columns), as a stream in append
    mode. at counts in milliseconds; events of a key and time go by their number. Events later than `late` are left out,
    as in any stream with a watermark."""
    if feed.sparkSession.conf.get(_PROVIDER, None) != ROCKSDB:
        raise ValueError(f"set {_PROVIDER} to {ROCKSDB}")
    rows = feed.withWatermark("at", late).groupBy(key)
    return rows.transformWithStateInPandas(_InOrder(rule, key), f"{key} string, {rule.output}", "append", "eventTime")


def rotations(feed: DataFrame, ttl_ms: int, late: str) -> DataFrame:
    """(family, at, number, token, outcome) of a stream (family, at, number, kind, token, other): issued, rotated,
    expired, unknown, refused, or reused, which revokes all of the family. A family is forgotten when its last token has
    expired."""
    return in_order(feed, Rotation(ttl_ms), "family", late)


def quiet_work(feed: DataFrame, delay_ms: int, again_ms: int, late: str) -> DataFrame:
    """(key, at, changes, first, last): a row each time that work on a key begins, from a stream (key, at, number, kind)
    of changes and ends of work."""
    return in_order(feed, Quiet(delay_ms, again_ms), "key", late)
