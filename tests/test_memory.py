"""Memory blocks and changes to notes."""

from pyspark.sql import functions as F

from lodestar.operators import writers
from lodestar.sources import memory

NOTE = """---
title: Memory
---
# Memory
before
## 2026-01-02 03:04 · decision

The pump is iron.
Two lines.

**Why:** it lasts
and lasts

not part of why
**Key:** pump / part / metal
**Valid from:** 2026-01-01

**Replaces:** 2025-12-31 10:00, 2025-12-31 10:00 #2
**Supersedes:** 2025-12-31 10:00

*via mcp:desk app*

## 2026-01-02 03:04 · preference\r
Second of its stamp.
## not a block
still the second
## 2026-01-03 00:00 · x y
still
## 2026-01-04 00:00 · fact
"""


def test_blocks(spark):
    notes = spark.createDataFrame([("m.md", NOTE), ("none.md", None), ("plain.md", "text")], "id string, body string")
    got = memory.block_fields(memory.blocks(notes)).orderBy("note", "ord").collect()
    assert [(r.ord, r.id, r.category) for r in got] == [(0, "2026-01-02 03:04", "decision"), (1, "2026-01-02 03:04 #2", "preference"), (2, "2026-01-04 00:00", "fact")]
    first = got[0]
    assert first.fact == "The pump is iron.\nTwo lines." and first.why == "it lasts\nand lasts" and first.how is None
    assert (first.subject, first.attribute, first.valid_from, first.valid_until, first.via) == ("pump / part", "metal", "2026-01-01", None, "mcp:desk app")
    assert first.replaces == ["2025-12-31 10:00", "2025-12-31 10:00 #2"]
    assert got[1].text == "Second of its stamp.\n## not a block\nstill the second\n## 2026-01-03 00:00 · x y\nstill" and got[1].replaces == [] and got[1].via is None
    assert got[2].text == "" and got[2].fact == ""


def test_written_blocks_are_read_back(spark):
    row = spark.createDataFrame([("2026-02-03 04:05", "decision", " Iron it is. ", "because", None, "pump / metal", "app")], "stamp string, category string, fact string, why string, how string, key string, via string")
    labels = {"Why": F.col("why"), "How to apply": F.col("how"), "Key": F.col("key")}
    text = row.select(F.lit("m").alias("id"), F.concat(F.lit("# M\n\n"), memory.rendered(F.col("stamp"), F.col("category"), F.col("fact"), labels, F.col("via"))).alias("body"))
    got = memory.block_fields(memory.blocks(text)).first()
    assert (got.id, got.fact, got.why, got.how, got.subject, got.attribute, got.via) == ("2026-02-03 04:05", "Iron it is.", "because", None, "pump", "metal", "mcp:app")


def test_sections_of_facts(spark):
    h = "2026-01-02 03:04 · decision"
    rows = [(0, "Memory", "# Memory"), (1, h, f"## {h}\nlong"), (2, h, "goes on"), (3, "2026-01-02 03:04 · fact", "## 2026-01-02 03:04 · fact\nx"), (4, h, f"## {h}\nthird"), (5, h, "and on")]
    df = spark.createDataFrame([("m", *r) for r in rows], "id string, ord int, heading string, text string")
    got = {r.ord: r.fact for r in memory.section_facts(df).collect()}
    assert got == {0: None, 1: "2026-01-02 03:04", 2: "2026-01-02 03:04", 3: "2026-01-02 03:04 #2", 4: "2026-01-02 03:04 #3", 5: "2026-01-02 03:04 #3"}


def test_remembered(spark):
    now = spark.createDataFrame([("a", "decision", "k1", ["pump", "iron", "old", "blue"]), ("b", "fact", None, ["roof", "slate", "grey"]), ("c", "decision", None, ["door", "oak", "wide", "tall"])], "id string, category string, key string, terms array<string>")
    new = [
        ("n1", "decision", None, ["pump", "iron", "old"], [], False), ("n2", "decision", None, ["pump", "iron", "old"], [], True), ("n3", "decision", "k1", ["pump", "steel"], [], False),
        ("n4", "decision", None, ["door", "oak", "narrow", "low"], [], False), ("n5", "fact", None, ["door", "oak", "narrow", "low"], [], False), ("n6", "decision", None, ["door", "oak", "narrow", "low"], ["c"], False),
        ("n7", "fact", None, ["new"], None, None),
    ]
    got = {r.id: (r.verdict, r.match, r.replaces) for r in memory.remembered(spark.createDataFrame(new, "id string, category string, key string, terms array<string>, named array<string>, force boolean"), now).collect()}
    assert got == {
        "n1": ("duplicate", "a", []), "n2": ("stored", None, []), "n3": ("stored", None, ["a"]), "n4": ("held", "c", []), "n5": ("stored", None, []), "n6": ("stored", None, ["c"]), "n7": ("stored", None, []),
    }


def test_sections_replaced(spark):
    notes = spark.createDataFrame(
        [("a", "# T\n\n## One\nold\n### Sub\nold\n## Two\nkeep"), ("b", "## One\nx\n## one\ny"), ("c", "```\n## One\n```\nz"), ("d", "## One"), ("e", "## One\nother")], "id string, body string"
    )
    edits = spark.createDataFrame([(k, "## one", " new ") for k in "abcd"], "id string, heading string, content string")
    got = {r.id: (r.body, r.error) for r in writers.with_section(notes, edits).collect()}
    assert got == {
        "a": ("# T\n\n## One\n\nnew\n\n## Two\nkeep", None), "b": ("## One\nx\n## one\ny", "more than one such heading"), "c": ("```\n## One\n```\nz", "no such heading"), "d": ("## One\n\nnew\n", None),
    }
    once = spark.createDataFrame([("a b a", "b", "c"), ("a b a", "a", "c"), ("x", "y", "c"), ("x", "", "c")], "t string, o string, n string")
    assert [r[0] for r in once.select(writers.replaced_once(F.col("t"), F.col("o"), F.col("n"))).collect()] == ["a c a", None, None, None]


def test_captured(spark):
    from lodestar.sources import vault

    items = spark.createDataFrame([('Say "hi": now', "text", "House", ["Stone"]), ("Plan", "one", None, []), ("plan", "two", None, None), ("???", "x", None, None)], "title string, text string, project string, topics array<string>")
    there = spark.createDataFrame([("In/plan.md",), ("In/Plan 4.md",), ("Else/Untitled.md",)], "id string")
    got = {r.id: r.raw for r in writers.captured(items, there, "In", "2026-01-02").collect()}
    assert set(got) == {"In/Say hi now.md", "In/Plan 5.md", "In/plan 6.md", "In/Untitled.md"}
    raw = spark.createDataFrame([(k, v, "2000-01-01") for k, v in got.items()], "id string, raw string, day string")
    note = vault.parsed(raw).where("id = 'In/Say hi now.md'").first()
    assert (note.title, note.project, note.topics, note.tags, note.captured) == ('Say "hi": now', "House", ["Stone"], ["captured"], "2026-01-02")


def test_cascades_and_broken_links(spark):
    notes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, v int")
    kids = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "note_id string, ord int")
    left, rest = writers.without(notes, notes.where("id = 'a'"), (kids, "note_id"))
    assert {r.id for r in left.collect()} == {"b", "c"} and [tuple(r) for r in rest.collect()] == [("b", 1)]
    new = spark.createDataFrame([("a", 2), ("d", 2)], "id string, v int")
    up, kids2 = writers.upserted(notes, new, (kids, spark.createDataFrame([("a", 9)], "note_id string, ord int"), "note_id"))
    assert {tuple(r) for r in up.collect()} == {("a", 2), ("b", 1), ("c", 1), ("d", 2)} and {tuple(r) for r in kids2.collect()} == {("b", 1), ("a", 9)}
    before = spark.createDataFrame([("x", "a"), ("y", "b"), ("z", None)], "from_id string, to_id string")
    after = spark.createDataFrame([("x", None), ("y", "b")], "from_id string, to_id string")
    assert [tuple(r) for r in writers.broken_links(before, after).collect()] == [("x", "a")]
