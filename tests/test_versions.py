"""Changes of several relations are seen whole or not at all, wherever a writer stops."""

import tempfile

import pytest

from lodestar.operators.changes import latest
from lodestar.streaming import feeds
from lodestar.streaming.versions import Versions

RELATIONS = {"notes": "id", "sections": "note_id", "edges": "from_id"}


def rows(spark, ids, text):
    ids = list(ids)
    return {
        "notes": spark.createDataFrame([(i, text) for i in ids], "id string, title string"),
        "sections": spark.createDataFrame([(i, k, text) for i in ids for k in range(2)], "note_id string, ord int, text string"),
        "edges": spark.createDataFrame([(i, "a") for i in ids if i != "a"], "from_id string, to_id string"),
    }


def ids(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "id string")


def state(v, number=None):
    columns = {"notes": ["id", "title"], "sections": ["note_id", "ord", "text"], "edges": ["from_id", "to_id"]}
    return {name: sorted(map(tuple, v.read(name, number).select(*columns[name]).collect())) for name in v.relations}


def want(**titles):
    return {
        "notes": sorted(titles.items()), "sections": sorted((i, k, t) for i, t in titles.items() for k in range(2)), "edges": sorted((i, "a") for i in titles if i != "a"),
    }


def started(spark, relations=RELATIONS):
    v = Versions(spark, tempfile.mkdtemp(prefix="spark-"), relations)
    v.change(ids(spark, "a", "b", "c"), rows(spark, "abc", "one"), batch=0)
    return v


def test_changes(spark):
    v = started(spark)
    assert v.numbers() == [1] and state(v) == want(a="one", b="one", c="one")
    assert v.change(ids(spark, "b", "c", "d"), rows(spark, "bd", "two"), batch=1) == 2  # c is deleted
    assert state(v) == want(a="one", b="two", d="two") and state(v, 1) == want(a="one", b="one", c="one")
    assert v.change(ids(spark, "a"), rows(spark, "a", "again"), batch=1) == 2  # that batch has been
    # rows of notes that aren't named as changed don't count
    v.change(ids(spark, "c"), rows(spark, "ac", "three"), batch=2)
    assert state(v) == want(a="one", b="two", c="three", d="two")
    before = v.read("sections")
    assert v.compacted() == 4 and state(v) == want(a="one", b="two", c="three", d="two") == state(v, 3)
    assert before.count() == 8  # a reader of the version before goes on
    assert v.swept() > 0 and v.numbers() == [4] and state(v) == want(a="one", b="two", c="three", d="two")
    v.change(ids(spark, "a"), {})
    assert state(v) == want(b="two", c="three", d="two")


class Stopped(Exception):
    pass


@pytest.mark.parametrize("what", ["change", "compacted"])
def test_a_writer_that_stops(spark, monkeypatch, what):
    """Stopped before or after any step, readers have the old state or the new one, and the next writer goes on."""
    two = {k: RELATIONS[k] for k in ("notes", "sections")}
    old, new = ({k: x[k] for k in two} for x in (want(a="one", b="one", c="one"), want(a="one", b="two")))
    work = {"change": lambda v: v.change(ids(spark, "b", "c"), rows(spark, "b", "two"), batch=1), "compacted": lambda v: v.compacted()}[what]
    steps = 2 * 4  # three folders and the rename, before and after each
    for stop in range(steps):
        v = started(spark, two)
        count = iter(range(steps + 1))

        def broken(step, count=count, stop=stop):
            def run(*args):
                if next(count) == stop:
                    raise Stopped
                step(*args)
                if next(count) == stop:
                    raise Stopped

            return run

        with monkeypatch.context() as m:
            m.setattr(v, "_written", broken(v._written))
            m.setattr(v, "_published", broken(v._published))
            with pytest.raises(Stopped):
                work(v)
        fresh = Versions(spark, v.root, two)
        done = stop == steps - 1
        assert state(fresh) == (new if done and what == "change" else old)
        fresh.change(ids(spark, "b", "c"), rows(spark, "b", "two"), batch=1)
        assert state(fresh) == new
        fresh.swept()
        assert state(fresh) == new


def test_two_writers(spark):
    v, other = started(spark), None
    other = Versions(spark, v.root, RELATIONS)
    said = v.manifest()
    other.change(ids(spark, "a"), rows(spark, "a", "first"))
    with pytest.raises(RuntimeError, match="published"):
        v._published(said | {"number": said["number"] + 1})
    assert state(v) == want(a="first", b="one", c="one")


def test_compaction_of_a_feed_survives_a_batch_run_again(spark):
    """The last batch is run again after its folder was merged with others: no key is lost."""
    top = tempfile.mkdtemp(prefix="spark-")
    make = lambda rows: spark.createDataFrame(rows, "key long, seq long, v string")
    batches = [make([(1, 1, "a"), (2, 2, "b")]), make([(3, 3, "c")])]
    for k, b in enumerate(batches):
        latest(b, "key", "seq").write.parquet(f"{top}/batch={k}")
    feeds.compact(spark, top, "key", "seq")
    batches[1].write.mode("overwrite").parquet(f"{top}/batch=1")
    have = lambda: sorted(map(tuple, feeds.current(spark, top, "key", "seq").select("key", "v").collect()))
    assert have() == [(1, "a"), (2, "b"), (3, "c")]
    feeds.compact(spark, top, "key", "seq")
    assert have() == [(1, "a"), (2, "b"), (3, "c")]
