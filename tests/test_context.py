"""Packs, identity, views, settings, linking sentences, places by meaning and evaluation cases on small rows."""

import json
import math

from pyspark.sql import functions as F

from lodestar.operators import context as X
from lodestar.operators import graph as G
from lodestar.sources import cases


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


NOTES = [("a", "Water pump", "note", "2025-02-20"), ("b", "Barn", "note", "2020-01-01"), ("h", "Water hub", "hub", "2025-02-20"), ("c", "Far", "note", "2020-01-01")]
SECTIONS = [("a", 0, "Water pump", "x" * 100), ("a", 1, "Pump parts", "y" * 100), ("b", 0, "Barn", "z" * 5000), ("h", 0, "Water hub", "h"), ("c", 0, "Far", "c")]


def test_lexical_candidates(spark):
    q = frame(spark, [("q", ["water", "pumps"]), ("only", ["hub"])], "query_id string, terms array<string>")
    hits = frame(spark, [("q", "a", 1, 1), ("q", "b", 0, 2), ("q", "h", 0, 3), ("only", "h", 0, 1)], "query_id string, note string, ord int, rank int")
    whole = frame(spark, [("q", "a", 1), ("q", "c", 2)], "query_id string, note string, rank int")
    linked = frame(spark, [("b", "a")], "a string, b string")
    got = {(r.query_id, r.note, r.ord): (round(r.score, 9), r.rank) for r in X.lexical_candidates(
        q, hits, whole, frame(spark, NOTES, "id string, title string, type string, modified string"), frame(spark, SECTIONS, "id string, ord int, heading string, text string"), linked, "2025-03-01"
    ).collect()}
    assert got == {
        ("q", "a", 1): (round(1 / 60 + 0.7 / 60 + 0.002 + 0.02 + 0.01 * 0.5, 9), 1),
        ("q", "b", 0): (round(1 / 61 + 0.004, 9), 2),
        ("q", "c", 0): (round(0.7 / 61, 9), 3),
        ("only", "h", 0): (round(1 / 60 + 0.002 + 0.02, 9), 1),
    }


def test_pack(spark):
    ranked = frame(spark, [("q", "b", 0, 1), ("q", "a", 0, 2), ("q", "a", 1, 3), ("q", "c", 0, 4)], "query_id string, note string, ord int, rank int")
    sections = frame(spark, SECTIONS, "id string, ord int, heading string, text string")
    got = [(r.rank, r.note, len(r.text)) for r in X.pack(ranked, sections, budget=3_650, per_note=1).orderBy("rank").collect()]
    assert got == [(1, "b", 3500 + len(X.CUT)), (2, "a", 100), (4, "c", 1)]  # one of a note; what doesn't fit is passed over
    assert [r.rank for r in X.pack(ranked, sections, budget=10).collect()] == [1]  # the first anyway
    pack = X.pack(ranked, sections)
    flags = frame(spark, [("a", 1, "replaced by x")], "note string, ord int, flag string")
    assert {r.rank: r.text[:15] for r in X.flagged(pack, flags).collect()}[3] == "[replaced by x]"
    text = X.rendered(pack, frame(spark, NOTES, "id string, title string, type string, modified string")).first()
    assert (text.n_sections, text.n_notes) == (4, 3) and text.text.index("## Barn `b`") < text.text.index("## Water pump `a`") < text.text.index("## Far `c`")


def test_identity(spark):
    schema = "id string, title string, type string, modified string, text string"
    some = lambda n, size, day="2025-01-0": frame(spark, [(f"n{k}", f"T{k}", "note", f"{day}{k}", "t" * size) for k in range(1, n + 1)], schema)
    none = some(1, 1).limit(0)
    rows = X.identity(some(1, 50), some(5, 300), none, some(1, 900), none, some(2, 3), budget=2_000, reserve=1_000).orderBy("part", "no").collect()
    assert [(r.part, r.no) for r in rows] == [(1, 1), (2, 1), (2, 2), (4, 1), (6, 1), (6, 2)]
    assert rows[1].text.startswith("### T5 · note · 2025-01-05") and len(rows[3].text) < 330 and rows[3].text.endswith("…")
    parts = frame(spark, [("q", 1, "aaa"), ("q", 2, "bbbb"), ("q", 3, "c")], "q string, no int, text string")
    assert [r.no for r in X.within(parts, "q", 6).collect()] == [1]
    one = frame(spark, [("# M\n\n## one\nxx\n## two\nyy",)], "t string").select(X.capped_newest(F.col("t"), 12).alias("a"), X.capped_newest(F.col("t"), 100).alias("b"), X.capped(F.col("t"), 3, "!").alias("c")).first()
    assert one.a == "## two\nyy" and one.b.startswith("# M") and one.c == "# M!"


def test_identity_of_a_topic(spark):
    schema = "id string, title string, type string, modified string, text string, topics array<string>"
    rows = [(f"n{k:02d}", f"Title {k}", "note", f"2025-01-{k:02d}", "common text " + ("pumping iron" if k % 5 == 0 else "") + (" ox" if k == 7 else " oxen"), ["Barn"] if k == 3 else None) for k in range(1, 21)]
    memory = frame(spark, rows, schema)
    ids = lambda topic: sorted(r.id for r in X.about(memory, topic).collect())
    assert ids("The pumps, in common") == ["n05", "n10", "n15", "n20"]  # common says nothing, pump(s) begins pumping
    assert ids("barns or ox") == ["n03", "n07"]  # short terms are whole words
    newest = ["n16", "n17", "n18", "n19", "n20"]
    assert ids("common") == newest and ids("elephants") == newest and ids("what is the") == newest
    none = memory.limit(0)
    got = X.identity(none, memory, memory, none, none, none, budget=2_000, reserve=1_000, topic="pump", facts_budget=90).orderBy("part", "no").collect()
    assert [(r.part, r.no) for r in got] == [(2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2)] and got[0].text.startswith("### Title 20") and "Title 20" in got[4].text


def test_running_sums(spark):
    """A key with most rows, and no key at all, against sums in order."""
    import random

    from lodestar.operators.running import numbered, running_sum

    r = random.Random(8)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.randrange(50), k, r.choice([None, 1, 5])) for k in range(400)]
    df = frame(spark, rows, "k string, a int, b int, v int").repartition(5)
    order = [F.desc("a"), F.col("b")]
    for by in (["k"], []):
        total, want, n = {}, {}, {}
        for k, a, b, v in sorted(rows, key=lambda x: (-x[1], x[2])):
            key = k if by else 0
            total[key] = total.get(key, 0) + (v or 0)
            n[key] = n.get(key, 0) + 1
            want[b] = (total[key], n[key])
        sums = {x.b: x.used for x in running_sum(df, F.col("v"), order, by).collect()}
        nos = {x.b: x.no for x in numbered(df, order, by).collect()}
        assert {b: (sums[b], nos[b]) for b in sums} == want


def test_texts_are_not_one_tasks_work(spark):
    """The plan brings no text to a single partition."""
    schema = "id string, title string, type string, modified string, text string"
    some = frame(spark, [(f"n{k}", "T", "note", "2025-01-01", "t") for k in range(9)], schema)
    plan = X.identity(some.limit(1), some, some, some, some, some)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.splitlines() if "Window" in x and "row_number" in x]
    assert lines and not any("text#" in x for x in lines)


def test_views(spark):
    notes = frame(spark, [("a", "A", "P", "2025-01-01"), ("b", "B", "P", "2025-01-03"), ("c", "C", None, "2025-01-02")], "id string, title string, project string, modified string")
    links = frame(spark, [("a", "b"), ("b", "a"), ("c", "a"), ("a", "a"), ("a", "b")], "a string, b string")
    topics = frame(spark, [("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("c", "y")], "id string, topic string")
    got = [tuple(r) for r in X.graph_view("a", links, notes, topics).collect()]
    assert sorted(got) == [("back", "", 1, "c", "C"), ("back", "P", 1, "b", "B"), ("out", "", 1, "a", "A"), ("out", "", 2, "b", "B"), ("topics", "x", 2, "b", "B"), ("topics", "x|y", 1, "c", "C")]
    edges = frame(spark, [("a", 3, "B"), ("a", 1, "C"), ("a", 2, "B")], "a string, pos int, title string")
    read = {r.id: r.links for r in X.read_view(notes.withColumn("body", F.lit("t")), edges).collect()}
    assert read == {"a": ["C", "B"], "b": [], "c": []}
    assert {r.id: r.links for r in X.read_view(notes.withColumn("body", F.lit("t")), edges, 1).collect()}["a"] == ["C"]


def test_linking_sentences(spark):
    picks = [("q", "n1", 0, "s", "Seed", "out"), ("q", "n2", 0, "s", "Seed", "in"), ("q", "n3", 1, "s", "Seed", "in"), ("q", "n4", 0, "s", "Seed", "out")]
    occ = [
        ("s", "n1", 0, 0, 0.3, "weak " + "w" * 300), ("s", "n1", 1, 1, 0.3, "near one"), ("s", "n1", 2, 1, 1.0, "near and heavy"), ("n2", "s", 0, 0, 1.0, "shown in the section"), ("n3", "s", 0, 0, 1.0, "Elsewhere " + "x" * 300),
        ("s", "n4", 0, None, 0.3, None),
    ]
    windows = [("q", "s", 0, 0.1, "Seed"), ("q", "s", 1, 0.9, "Parts"), ("q", "n3", 0, 0.2, "N3")]
    got = {r.note: r.prefix for r in G.linking_sentences(
        frame(spark, picks, "query_id string, note string, ord int, seed string, seed_title string, dir string"), frame(spark, occ, "a string, b string, pos int, ord int, weight double, ctx string"),
        frame(spark, windows, "query_id string, note string, ord int, cos double, heading string"),
    ).collect()}
    assert set(got) == {"n1", "n3"} and got["n1"] == "Linked from Seed / Parts: near and heavy"
    assert got["n3"].startswith("Links to Seed: Elsewhere xx") and got["n3"].endswith("…") and len(got["n3"]) == len("Links to Seed: ") + 200


def test_settings():
    assert G.settings(None)["slots"] == 10 and G.settings(True)["enabled"] and not G.settings(None)["enabled"]
    got = G.settings({"slots": 99, "seeds": 0, "minWeight": float("nan"), "swapWeight": "x", "linksPerSeed": 2.6, "prefix": False, "enabled": "true", "keepMinWeight": 0})
    assert got == {"slots": 64, "seeds": 1, "minWeight": 0.2, "swapWeight": 1, "linksPerSeed": 3, "prefix": False, "enabled": True, "keepLinked": 1, "keepMinWeight": 0.01}


def test_meaning(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(k % 9, rng.normal(size=6) * [5, 3, 2, 0.3, 0.2, 0.1]) for k in range(27)]
    got = {r.note: r.sem for r in G.meaning(frame(spark, [(n, [float(x) for x in v]) for n, v in rows], "note int, v array<double>")).collect()}
    x = np.array([np.mean([v for n, v in rows if n == k], axis=0) for k in range(9)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    x -= x.mean(0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    for c in range(3):
        want = x @ axes[c]
        want /= np.abs(want).max()
        mine = np.array([got[k][c] for k in range(9)])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 0.02 and np.abs(mine).max() == 1
    assert G.meaning(frame(spark, [(k, [1.0, 2.0]) for k in range(3)], "note int, v array<double>")).collect() == []
    one = frame(spark, [([0.0, 1.0, 0.5], False), ([-1.0, 0.0, 0.0], True), (None, False)], "sem array<double>, muted boolean").select(G.colour(F.col("sem"), F.col("muted")).alias("c"), G.node_size(F.lit(32)).alias("s")).collect()
    assert [tuple(map(round, r.c)) for r in one] == [(90, 70, 64), (180, 21, 60), (225, 6, 62)] and math.isclose(one[0].s, 2 + 1.2 * 16)
    links = frame(spark, [("a", "b", 0.5), ("a", "h", 0.5), ("a", "c", 0.1)], "x string, y string, strength double")
    nodes = frame(spark, [("a", False), ("b", False), ("c", False), ("h", True)], "id string, structural boolean")
    assert [r.y for r in G.visible(links, nodes, hubs=False).collect()] == ["b"] and G.visible(links, nodes).count() == 2


def fnv(text):
    h = 0x811C9DC5
    for c in text:
        h = ((h ^ ord(c)) * 0x01000193) % 2**32
    return h


def test_cases(spark, tmp_path):
    rows = [
        {"id": "x1", "cls": "date", "q": "When?", "gold": ["a.md"], "evidence": [["One  *Two*", "three"], ["four"]]}, {"query": "Who?", "category": "abstain", "gold": ["b"]},
        {"id": "x2", "family": "f", "q": "How?", "required": ["r"], "qrels": {"g3": 3, "g2": 2, "r": 3}}, {"id": "x3", "q": "Why?", "qrels": {"g2": 2, "g1": 1}}, {"id": "x4", "q": "flat", "evidence": ["p", "q"]},
    ]
    (tmp_path / "list.json").write_text(json.dumps(rows))
    (tmp_path / "object.json").write_text(json.dumps({"queries": rows}))
    for name in ("list.json", "object.json"):
        got = {r.id: r for r in cases.cases(spark, str(tmp_path / name)).collect()}
        assert set(got) == {"x1", "case-2", "x2", "x3", "x4"}
        assert got["x1"].gold == ["a.md"] and got["x1"].evidence == [["One  *Two*", "three"], ["four"]] and got["x1"].cls == "date"
        assert got["case-2"].offtopic and got["case-2"].gold == [] and got["case-2"].split == "all" and got["case-2"].question == "Who?"
        assert set(got["x2"].gold) == {"r", "g3"} and got["x3"].gold == ["g2"] and got["x4"].evidence == [["p"], ["q"]]
        assert got["x1"].split == ("dev" if fnv("brb:x1") % 4 == 0 else "test") and got["x2"].split == ("dev" if fnv("brb:f") % 4 == 0 else "test")
    words = ["brb:x1", "", "é", "a" * 50]
    assert [r[0] for r in frame(spark, [(w,) for w in words], "t string").select(cases.fnv1a(F.col("t"))).collect()] == [fnv(w) for w in words]
    packs = frame(spark, [("x1", "say ONE two\n`here`"), ("x4", "p only")], "id string, text string")
    found = {r.id: (r.n_groups, r.n_found, r.complete) for r in cases.covered(cases.cases(spark, str(tmp_path / "list.json")), packs).collect()}
    assert found == {"x1": (2, 1, False), "x4": (2, 1, False)}
    assert [r[0] for r in frame(spark, [("ﬁve  *x*_`",), (None,)], "t string").select(cases.evidence_text("t")).collect()] == ["five x", None]
