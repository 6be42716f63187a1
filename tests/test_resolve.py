"""Link resolution stage by stage, against a walk over all notes for each link."""

import random
import re

from lodestar.operators import resolve

NOTES = [
    ("Plan.md", "The plan", ["PL", "[[Old plan]]"]), ("A/Plan.md", "Plan", None), ("A/B/Plan.md", "Plan", []), ("A/B/GitHub account.md", "Account", ["git hub"]), ("C/B/Note One.md", "note  one", [None]),
    ("C/zz.md", "Twin", ["both"]), ("D/a.md", "twin", ["Both"]), ("D/long name.md", "Twin", []), ("E/x_y.md", None, ["A/B/Plan"]), ("E/F/G/deep-note.md", "a/b", []), ("E/F/G/H.MD", "", [""]),
]


def fold(s):
    return re.sub(r"\s+", " ", s).strip().lower()


def slug(s):
    return re.sub(r"[-_\s]+", " ", s.lower()).strip()


def where(path):
    return path.rpartition("/")[0]


def direct(from_id, target, notes, shorthands, again=True):
    key = fold(target or "")
    if not key:
        return None
    stages = [[] for _ in range(8)]
    for id, title, aliases in notes:
        parts = [fold(p) for p in re.sub(r"(?i)\.md$", "", id).split("/")]
        also = [fold(re.sub(r"^\s*\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]\s*$", r"\1", a)) for a in aliases or [] if a is not None]
        ends = ["/".join(parts[i:]) for i in range(1, len(parts) - 1)]
        slugs = ["/".join(slug(p) for p in x.split("/")) for x in ["/".join(parts), *ends]]
        by = "/".join(slug(p) for p in key.split("/"))
        stages[0] += [id] if "/".join(parts) == key else []
        stages[1] += [id] if key in ends else []
        stages[2] += [id] if "/" in key and slugs[0] == by else []
        stages[3] += [id] if "/" in key and by in slugs[1:] else []
        stages[4] += [id] if fold(title or "") == key else []
        stages[5] += [id] if parts[-1] == key else []
        stages[6] += [id] if key in also else []
        stages[7] += [id] if slug(key) and slug(key) in [slug(title or ""), slug(parts[-1]), *map(slug, also)] else []
    for found in stages:
        if found:
            near = [x for x in found if where(x) == where(from_id)]
            return min(near or found, key=lambda x: (len(x), x))
    return direct(from_id, shorthands[key], notes, {}, False) if again and key in shorthands else None


def test_stages(spark):
    r = random.Random(3)
    targets = ["Plan", "plan ", "A/Plan", "B/Plan", "b/plan", "a/b/github-account", "B/github_account", "GitHub account", "git-hub", "pl", "Old plan", "TWIN", "both", "note-one", "x y", "a/b", "A/B/Plan", "F/G/deep note", "G/deep_note", "h", "", None, " ", "gone", "mcp", "/", "--"]
    froms = ["Plan.md", "A/B/Plan.md", "C/zz.md", "D/a.md", "E/F/G/H.MD", "elsewhere/n.md"]
    shorthands = {"mcp": "Note One", "gone": "nothing at all"}
    links = [(f, t, r.randrange(9)) for f in froms for t in targets] + [("A/Plan.md", "Plan", 1)] * 3
    df = spark.createDataFrame(links, "from_id string, target string, stage0 int")
    got = resolve.resolved(df, spark.createDataFrame(NOTES, "id string, title string, aliases array<string>"), shorthands)
    rows = got.collect()
    assert len(rows) == len(links)
    for x in rows:
        assert x.to_id == direct(x.from_id, x.target, NOTES, shorthands), (x.from_id, x.target)
    assert {x.stage for x in rows} == {None, *resolve.STAGES}
    assert {(x.name, x.n) for x in resolve.ambiguous(got).collect()} >= {("twin", 3), ("both", 2)}
    assert resolve.resolved(df.limit(0), spark.createDataFrame(NOTES, "id string, title string, aliases array<string>")).collect() == []


def test_a_hot_title_is_one_row(spark):
    """Names are reduced before links meet them."""
    notes = spark.createDataFrame([(f"f{k % 3}/{k:03d}.md", "Untitled", None) for k in range(300)], "id string, title string, aliases array<string>")
    overall, near = resolve.dictionary(resolve.names(notes))
    assert overall.where("name = 'untitled'").count() == 2  # as it is and as words joined alike
    assert near.where("name = 'untitled' and way = 'plain'").count() == 3
    links = spark.createDataFrame([(f"f{k % 4}/new.md", "Untitled") for k in range(200)], "from_id string, target string")
    got = {(x.from_id, x.to_id, x.n) for x in resolve.resolved(links, notes).collect()}
    assert got == {("f0/new.md", "f0/000.md", 300), ("f1/new.md", "f1/001.md", 300), ("f2/new.md", "f2/002.md", 300), ("f3/new.md", "f0/000.md", 300)}
