"""Notes parsed from Markdown: where links stand, sections and windows, frontmatter, and a folder read by Spark."""

import pytest

from lodestar.functions import markdown as M
from lodestar.sources import vault


def kinds(body, fields=None):
    return " ".join(f"{x['kind']}{':' + x['fm_key'] if x['fm_key'] else ''}={x['target']}" for x in M.links(body, fields or {}))


@pytest.mark.parametrize(
    "body, want",
    [
        ("The cellar belongs to [[North]]; [[South]] feeds it in winter.", "sentence=North sentence=South"),
        ("Cf. [[North]].", "short=North"),
        ("* How to open it is told in [[North]].", "list_explained=North"),
        ("1. [[North]] / 2026-01-01 / [[South]]", "list_bare=North list_bare=South"),
        ("The work rests upon [[A]], [[B]], and [[C]].", "list_bare=A list_bare=B list_bare=C"),
        ("The work rests upon [[A]], then upon [[B]] and [[C]].", "sentence=A sentence=B sentence=C"),
        ("### After [[North]]", "heading=North"),
        ("> ## After [[North]]", "heading=North"),
        ("| k | [[North\\|up]] |", "table=North"),
        ("~~~\n[[Ghost]]\n~~~\nWith `[[Inner]]` and ![[plan.pdf]] there is ![[North]] to be seen.", "embed=North"),
        ("One sentence has [[A]] within it.\n\n---\n\n## Connections\n\nSee [[Home]].", "sentence=A trailer=Home"),
        ("One sentence has [[A]] within it.\r\n\r\n---\r\n\r\n## Connections\r\n\r\nSee [[Home]].", "sentence=A trailer=Home"),
        ("````\n```\n[[Ghost]]\n````\nAfterwards the pump leads to [[North]].", "sentence=North"),
        ("```py\nx\n```js\n[[Ghost]]\n```\nAfterwards the pump leads to [[North]].", "sentence=North"),
        ("```a`b\nAfterwards the pump leads to [[North]].", "sentence=North"),
        ("- [[the `pump` tool]]", "list_bare=the `pump` tool"),
        ("日本語の文章です [[North]] 続きます。", "sentence=North"),
        ("no links, [[broken\nlink]] and [] here", ""),
        ("", ""),
    ],
)
def test_link_kinds(body, want):
    assert kinds(body) == want


def test_field_links():
    got = kinds("x", {"topics": ["[[Stone]]"], "related": ["Plain Two"], "project": "[[Home]]", "seen-in": ["[[X]]", 3], "tags": ["t"]})
    assert got == "fm:topics=Stone fm:related=Plain Two fm:project=Home fm:seen-in=X"
    assert kinds("x", {"topics": "[[Stone]], Wood", "related": [1999]}) == "fm:topics=Stone fm:topics=Wood fm:related=1999"
    fields, body = M.frontmatter("---\nrelated: [[North]]\ntopics:\n  - [[Stone]]\nproject: [[Big House]]\n---\ntext\n")
    assert kinds("", fields) == "fm:related=North fm:topics=Stone fm:project=Big House" and body == "text\n"
    for broken in ("---\nx: [1\n---\nbody [[A]]", "---\n- a\n---\n", "---\nno end"):
        assert M.frontmatter(broken) == ({}, broken)


def test_contexts_and_headings():
    x = M.links("Old one. The valve told of in [[North wing|the wing]] holds well. Next one.", {})[0]
    assert x["ctx"] == "The valve told of in the wing holds well."
    x = M.links("| a | [[North#Set up\\|b]] |", {})[0]
    assert (x["target"], x["heading"], x["ctx"]) == ("North", "Set up", "| a | b |")
    assert M.links("in [[North.md#^block]] there", {})[0] | {"ctx": None} == {"kind": "short", "fm_key": None, "target": "North", "heading": None, "ctx": None, "line": 0, "col": 3}
    long = "word " * 200 + "![[North]]" + " word" * 200
    ctx = M.links(long, {})[0]["ctx"]
    assert "North" in ctx and len(ctx) <= 302 and ctx[0] == ctx[-1] == "…"


def test_sections_and_windows():
    body = "intro\n\n# One\ntext\n```\n# not one\n```\n## Two ##\n" + "\n\n".join("p" * 500 for _ in range(5)) + "\n\n---\n\n## Connections\nx"
    got = M.sections(body)
    assert [(s["ord"], s["heading"], s["level"]) for s in got] == [(0, "", 0), (1, "One", 1), (2, "Two", 2), (3, "Two", 2), (4, "Two", 2)]
    assert got[0]["text"] == "intro" and got[1]["text"].startswith("# One\ntext") and all(len(s["text"]) <= 1200 for s in got)
    assert M.sections("") == [] and M.sections("\n \n") == []
    assert M.windows("a" * 1700) == ["a" * 1700]  # under one and a half windows
    pieces = M.hard_cut("w " * 2000)
    assert all(len(x) <= 1200 for x in pieces) and "".join(x + " " for x in pieces).split() == ["w"] * 2000
    cut = M.hard_cut("x" * 1193 + " [[Some Long Name]] " + "y " * 300)
    assert cut[0] == "x" * 1193 and cut[1].startswith("[[Some Long Name]]")
    assert M.hard_cut("z" * 2500) == ["z" * 1200, "z" * 1200, "z" * 100]


def test_link_windows():
    line = "The same line names [[North]] again here."
    body = "```\n" + line + "\n```\n# A\n" + "filler " * 400 + "\n\n# B\n" + line + "\n\n# C\n" + line + "\n" + ("word " * 300 + "[[Far End]] ") * 2
    found, cut = M.links(body, {}), M.sections(body)
    ords = M.link_windows(body, found, cut)
    by = {s["ord"]: s for s in cut}
    assert [by[k]["heading"] for k in ords] == ["B", "C", "C", "C"]
    for x, k in zip(found, ords):
        assert "[[" + x["target"] in by[k]["text"]
    assert ords[2] < ords[3]
    assert M.link_windows("x", [M._link("fm", "related", "A", None)], M.sections("x")) == [None]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("notes")
    files = {
        "Home.md": "---\ntitle: Home\ntype: hub|main\nmodified: 2026-02-03\naliases: [House, The Place]\n---\nThe [[North wing]] is part of it.\n",
        "Wings/North wing.MD": "---\nproject: '[[Home]]'\ntopics: [[Stone]]\nvisibility: Private\nmodified: 2026-13-99\n---\n# North wing\n\nCold + drafty, see [[Home#Plan|home]].\n\n## Plan\nä\n",
        "Wings/a%20b +c.md": "no frontmatter [[Nowhere]]",
        "broken.md": "---\ntitle: [1\n---\nall body",
        "empty.md": "---\ntitle: Nothing\n---\n",
        ".trash/gone.md": "x [[Y]]", "Templates/t.md": "x", "readme.txt": "no",
    }
    for name, text in files.items():
        (at / name).parent.mkdir(exist_ok=True)
        (at / name).write_bytes(text.encode())
    return str(at)


def test_folder(spark, folder):
    rows = vault.parsed(vault.scan(spark, folder, ("Templates",))).cache()
    by = {r.id: r for r in rows.collect()}
    assert set(by) == {"Home.md", "Wings/North wing.MD", "Wings/a%20b +c.md", "broken.md", "empty.md"}
    home, wing = by["Home.md"], by["Wings/North wing.MD"]
    assert (home.type, home.aliases, home.modified, home.links) == ("hub", ["House", "The Place"], "2026-02-03", ["North wing"])
    assert (wing.title, wing.project, wing.topics, wing.visibility, wing.modified) == ("North wing.MD", "Home", ["Stone"], "private", "2026-13-99")
    assert by["broken.md"].body == "---\ntitle: [1\n---\nall body" and by["broken.md"].title == "broken"
    assert by["empty.md"].sections == [] and by["empty.md"].title == "Nothing"
    assert {(r.from_id, r.kind, r.fm_key, r.target, r.from_ord) for r in vault.edges(rows).collect()} == {
        ("Home.md", "sentence", None, "North wing", 0), ("Wings/North wing.MD", "fm", "project", "Home", None), ("Wings/North wing.MD", "fm", "topics", "Stone", None),
        ("Wings/North wing.MD", "sentence", None, "Home", 0), ("Wings/a%20b +c.md", "short", None, "Nowhere", 0),
    }
    assert [(r.id, r.ord, r.heading) for r in vault.sections(rows).where("id = 'Wings/North wing.MD'").orderBy("ord").collect()] == [("Wings/North wing.MD", 0, "North wing"), ("Wings/North wing.MD", 1, "Plan")]
    assert {r.name for r in vault.titles(rows).where("id = 'Home.md'").collect()} == {"home", "house", "the place"}
    assert ("Home.md", "north wing") in {tuple(r) for r in vault.links(rows).collect()}
    kept, removed = vault.reindexed(rows.union(rows.limit(1).selectExpr("'old.md' as id", *rows.columns[1:])), rows)
    assert [r.id for r in removed.collect()] == ["old.md"] and kept.count() == 5
