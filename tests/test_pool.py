"""The pool of candidates against a walk over each question's rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import pool as P


def walk(lists, fused, nb, windows, probs, o):
    """One question, step by step. lists name -> keys; fused [(key, score)]; a key is note * 10 + section."""
    note = lambda key: key // 10
    best = fused[0][1]
    score = dict(fused)
    rank = {key: i + 1 for i, (key, _) in enumerate(fused)}
    head = fused[: o["head"]]
    pool = [(key, "head") for key, _ in head]
    for keys in lists.values():
        if keys and keys[0] not in [p[0] for p in pool]:
            pool.append((keys[0], "first"))
    agree = bool(lists["lex"] and lists["den"] and lists["lex"][0] == lists["den"][0] and lists["lex"][0] in [k for k, _ in fused[:3]])
    graph = {}
    if not agree:
        seeds = []
        for key, s in fused[: o["seeds"]]:
            if note(key) not in [x[0] for x in seeds]:
                seeds.append((note(key), key, s / best))
        taken = {note(k) for k, _ in pool}
        got, times = {}, {}
        for n, _, share in seeds:
            options = []
            for to, strength in nb.get(n, []):
                near = [(c, key) for key, c in windows.items() if note(key) == to]
                if strength >= o["least"] and to not in taken and near:
                    c, key = min((-c, key) for c, key in near)
                    options.append((round(share * strength * max(0, -c), 12), key))
            for s, key in sorted(options, key=lambda x: (-x[0], x[1]))[: o["each"]]:
                times[note(key)] = times.get(note(key), 0) + 1
                if note(key) not in got or s > got[note(key)][0]:
                    got[note(key)] = (s, key)
        picks = sorted(((s * (1 + 0.5 * (times[n] - 1)), key) for n, (s, key) in got.items()), key=lambda x: (-x[0], x[1]))[: o["slots"]]
        safe = {k for _, k, _ in seeds} | {k for keys in lists.values() for k in keys[:3]} | set(lists["exact"])
        words = set(lists["lex"][:10]) | set(lists["note"][:10])
        safe |= words & set(lists["den"][:10])
        j = len(head) - 1
        for s, key in picks:
            while j >= 3 and head[j][0] in safe:
                j -= 1
            if j < 3 or not s > head[j][1] / best:
                break
            pool.remove((head[j][0], "head"))
            graph[key] = s
            j -= 1
        pool += [(key, "graph") for key in graph]
    rows = []
    for i, (key, src) in enumerate(pool):
        rows.append({"key": key, "src": src, "i": i, "share": score.get(key, 0) / best, "reranked": not agree or i < 3, "prob": probs.get(key, 0.0)})
    low = min(r["prob"] for r in rows[:3])
    for r in rows:
        r["prob"] = r["prob"] if r["reranked"] else 0.9 * low * r["share"]
        r["score"] = 0.8 * r["prob"] + 0.2 * r["share"]
    top = max(r["prob"] for r in rows if r["src"] != "graph" and r["reranked"])
    rows.sort(key=lambda r: (-round(r["score"], 12), r["i"]))
    bar = max(0.02, 0.3 * max(r["score"] for r in rows if r["src"] != "graph"))
    stop, out, base = None, [], 0
    for r in rows:
        if top < o["floor"]:
            r["cut"] = "floor"
        elif r["src"] == "graph":
            r["cut"] = stop or ("floor" if r["prob"] < o["floor"] else "trim" if r["score"] < bar else "limit" if len(out) >= o["k"] else "kept")
        else:
            if not stop and base >= o["keep"] and r["score"] < bar:
                stop = "trim"
            if not stop and len(out) >= o["k"]:
                stop = "limit"
            r["cut"] = stop or "kept"
            base += not stop
        if r["cut"] == "kept":
            out.append(r)
    partner = {}
    if stop == "trim" and not agree and top >= o["floor"]:
        kept = list(dict.fromkeys(note(r["key"]) for r in out))
        anchor = {}
        for x in kept:
            for to, strength in nb.get(x, []):
                if strength >= 0.1 and to not in kept and (to not in anchor or strength > anchor[to][1]):
                    anchor[to] = (x, strength)
        for r in rows:
            n = note(r["key"])
            if len(partner) < min(1, o["k"] - len(out)) and r["cut"] == "trim" and r["reranked"] and r["src"] != "graph" and n not in kept and n in anchor:
                partner[r["key"]] = anchor[n][0]
                kept.append(n)
                r["cut"] = "kept"
    coverage = "none" if top < o["floor"] else "good" if top >= 0.3 else "thin"
    return [(r["key"], r["src"], place + 1, r["cut"], coverage, partner.get(r["key"])) for place, r in enumerate(rows)]


def question(r):
    keys = [n * 10 + s for n in range(14) for s in range(2)]
    lists = {name: r.sample(keys, r.randrange(1, 14)) for name in ("lex", "den", "note")} | {"exact": r.sample(keys, r.choice([0, 0, 2]))}
    if r.random() < 0.3:
        lists["den"] = [lists["lex"][0]] + [x for x in lists["den"] if x != lists["lex"][0]]
    total = {}
    for rows in lists.values():
        for i, key in enumerate(rows):
            total[key] = total.get(key, 0) + 1 / (61 + i)
    fused = sorted(total.items(), key=lambda x: (-x[1], x[0]))
    nb = {n: sorted(((m, round(r.random(), 3)) for m in r.sample(range(14), 5) if m != n), key=lambda x: (-x[1], x[0])) for n in range(14)}
    windows = {key: round(r.uniform(-0.3, 1), 4) for key in keys if r.random() < 0.8}
    scale = r.choice([1, 1, 1, 0.03])
    probs = {key: round(r.random() ** 3 * scale, 4) for key in keys if r.random() < 0.9}
    return lists, fused, nb, windows, probs


@pytest.mark.parametrize("k,keep", [(4, 2), (12, 3)])
def test_against_a_walk(spark, k, keep):
    r = random.Random(k)
    o = {"head": 8, "seeds": 4, "least": 0.2, "each": 2, "slots": 4, "k": k, "keep": keep, "floor": 0.05}
    asked = {q: question(r) for q in range(40)}
    nb = {}
    want = {}
    for q, (lists, fused, own, windows, probs) in asked.items():
        nb = nb or own
        want[q] = walk(lists, fused, nb, windows, probs, o)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    lists = {
        name: frame([(q, key, key // 10, i + 1) for q, a in asked.items() for i, key in enumerate(a[0][name])], "query_id long, key long, note long, rank int") for name in ("lex", "den", "exact", "note")
    }
    fused = frame([(q, key, key // 10, s, i + 1) for q, a in asked.items() for i, (key, s) in enumerate(a[1])], "query_id long, key long, note long, score double, rank int")
    links = frame([(n, m, s, "out") for n, rows in nb.items() for m, s in rows], "id long, nb long, strength double, dir string")
    windows = frame([(q, key // 10, key, c) for q, a in asked.items() for key, c in a[3].items()], "query_id long, note long, key long, cos double")
    probs = frame([(q, key, p) for q, a in asked.items() for key, p in a[4].items()], "query_id long, key long, prob double")
    seeds = P.seeds(fused, o["seeds"])
    plain = P.candidates(fused, lists, None, None, o["head"])
    picks = P.linked(P.reached(seeds, links, plain, o["least"]), windows, o["each"], o["slots"])
    pool = P.candidates(fused, lists, picks, P.protected(lists, seeds), o["head"])
    rows = P.partners(P.judged(P.scored(pool, probs), k, keep), links, k)
    got = {}
    for x in P.traced(rows, lists).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append((x.key, x.src, x.place, x.cut, x.coverage, x.partner))
    assert got == want
    every = [row for rows in want.values() for row in rows]
    assert {x[1] for x in every} == {"head", "first", "graph"} and {x[3] for x in every} >= {"kept", "trim", "floor"} | ({"limit"} if k == 4 else set()) and any(x[5] is not None for x in every)


def test_without_links_and_rows(spark):
    none = spark.createDataFrame([], "query_id long, key long, note long, score double, rank int")
    lists = {"lex": none.drop("score"), "den": none.drop("score")}
    pool = P.candidates(none, lists, None, None)
    probs = none.select("query_id", "key", F.col("score").alias("prob"))
    assert P.judged(P.scored(pool, probs), 8).collect() == []


def test_trace_adds_up(spark):
    """Every candidate of the trace is counted once in the funnel, by where it came from and by what became of it."""
    from conftest import SMALL
    from lodestar.plans import q_pool

    trace = [r.asDict() for r in q_pool.rank_trace(spark, SMALL).collect()]
    funnel = [r.asDict() for r in q_pool.rank_funnel(spark, SMALL).collect()]
    assert funnel and {r["query_id"] for r in trace} == {r["query_id"] for r in funnel}
    for f in funnel:
        mine = [r for r in trace if r["query_id"] == f["query_id"]]
        n = lambda what, name: sum(r[name] == what for r in mine)
        assert f["pool"] == len(mine) == sum(n(x, "src") for x in ("head", "first", "graph")) == sum(n(x, "cut") for x in ("kept", "floor", "trim", "limit"))
        assert all(f[x] == n(x, "src") for x in ("head", "first", "graph")) and all(f[x] == n(x, "cut") for x in ("kept", "floor", "trim", "limit"))
        assert sorted(r["place"] for r in mine) == list(range(1, len(mine) + 1)) and f["kept"] <= 8 and f["fused"] >= f["head"]
        assert all(r["fused_rank"] is not None and any(r[c] is not None for c in ("lex", "den", "title")) for r in mine if r["src"] != "graph")
    assert any(r["src"] == "graph" for r in trace)
