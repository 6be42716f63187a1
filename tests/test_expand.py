"""Stems, prefixes, spelling, other names, snippets and mentions."""

import random
import re
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.functions.stems import folded, porter
from lodestar.operators import expand
from lodestar.operators import retrieval as R

PAIRS = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper
feudalism feudal decisiveness decis hopefulness hope formaliti formal triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ
homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll is is a a x9 x9""".split()


@pytest.mark.parametrize("word, stem", list(zip(PAIRS[::2], PAIRS[1::2])))
def test_porter(word, stem):
    assert porter(word) == stem


def test_folded():
    assert folded("Crème ÀÉÎ ñ ß") == "creme aei n ß"


DOCS = [(1, "The pumps were motoring along"), (2, "a motor and a pump"), (3, "Café crème"), (4, "nothing here"), (5, None)]


def words(spark, rows=DOCS):
    return spark.createDataFrame(rows, "key long, text string").select("key", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("text"))


def test_stemmed_and_prefixed_search(spark):
    rows = words(spark)
    vocab = rows.select(F.explode("text").alias("term")).distinct()
    q = spark.createDataFrame([("q", ["motors", "pumping"]), ("c", ["cafe"]), ("none", ["zebra"])], "query_id string, terms array<string>")
    forms, asked = expand.stem_forms(vocab, q)
    got = {(r.query_id, r.key): r.matched for r in R.bm25(rows, asked, {"text": 1.0}, forms).collect()}
    assert got == {("q", 1): 2, ("q", 2): 2, ("c", 3): 1}
    q = spark.createDataFrame([("q", ["mot", "pump"])], "query_id string, terms array<string>")
    got = {(r.query_id, r.key): r.matched for r in R.bm25(rows, q, {"text": 1.0}, expand.prefix_forms(vocab, q)).collect()}
    assert got == {("q", 1): 2, ("q", 2): 2}


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_spelling_against_brute_force(spark):
    rng = random.Random(4)
    vocab = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 11))): rng.randint(1, 9) for _ in range(400)}
    asked = ["".join(rng.choice("abc") for _ in range(rng.randint(4, 11))) for _ in range(150)] + ["abcab1", *list(vocab)[:9]]
    got = {r.term: (r.correction, r.dist) for r in expand.corrections(spark.createDataFrame([(x,) for x in asked], "term string"), spark.createDataFrame(list(vocab.items()), "term string, df long")).collect()}
    want = {}
    for t in set(asked):
        most = 1 if len(t) <= 8 else 2
        if len(t) < 5 or re.search("[0-9]", t) or t in vocab:
            continue
        near = [(-((most - osa(t, w) + 1) * 1000 + n), w) for w, n in vocab.items() if n >= 2 and w[0] == t[0] and abs(len(w) - len(t)) <= most and osa(t, w) <= most]
        if near:
            want[t] = (min(near)[1], osa(t, min(near)[1]))
    assert got == want and len(want) > 20
    assert expand.distance("ca", "abc", 5) == 3 and expand.distance("abcd", "abdc", 2) == 1 and expand.distance("aaaa", "bbbb", 2) == 3


def test_expansion(spark):
    q = spark.createDataFrame([("a", "db speeds", ["db", "speeds"]), ("b", "the data base", ["data", "base"]), ("c", "pimp", ["pimp", "pump"])], "query_id string, text string, terms array<string>")
    fixed = spark.createDataFrame([("pimp", "pump"), ("speeds", "spades")], "term string, correction string")
    readable = spark.createDataFrame([("pump",)], "term string")
    got = {r.query_id: r.terms for r in expand.expanded(q, {"db": "database postgres", "data base": "database"}, fixed, readable).collect()}
    assert got == {"a": ["db", "speeds", "database", "postgres"], "b": ["data", "base", "database"], "c": ["pimp", "pump"]}


def test_snippets(spark):
    far = " ".join(f"w{k}" for k in range(40))
    rows = [(f"{far} The Pump, and iron! {far}", ["pump", "iron"]), ("No hit here at all", ["zz"]), ("pump", ["pump"]), ("", ["x"]), (f"pump {far} pump iron", ["pump", "iron"])]
    got = [r[0] for r in spark.createDataFrame(rows, "text string, terms array<string>").select(expand.snippet(F.col("text"), F.col("terms"), 8)).collect()]
    assert got[0] == " ... w39 The **Pump**, and **iron**! w0 w1 w2 ... " and got[1] == "No hit here at all" and got[2] == "**pump**" and got[3] == ""
    assert got[4].startswith(" ... ") and got[4].endswith("**pump** **iron**") and len(got[4].split()) == 9
    # a stretch begins where a sentence does rather than in its middle, unless more terms are elsewhere
    text = f"{far} ends. Here the next sentence has a pump in it and {far}"
    rows = [(text, ["pump"]), (text + " pump iron", ["pump", "iron"]), (None, ["x"]), ("x y", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string, terms array<string>").select(expand.snippet(F.col("text"), F.col("terms"), 8)).collect()]
    assert got[0] == " ... Here the next sentence has a **pump** in ... " and got[1].endswith("**pump** **iron**") and got[2:] == [None, None]


def stretches(text, asked, size):
    """Every stretch that counts, scored by looking at all its words."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    low = [text[a:b].lower() for a, b in words]
    n = len(words)
    sentence = [k == 0 or bool(re.search(r"[.:][ \t\r\n]+$", text[words[k - 1][1] : words[k][0]])) for k in range(n)]
    best, found = -1, 0
    for k in range(n):
        if low[k] not in asked:
            continue
        s = max(x for x in range(k + 1) if sentence[x])
        for start, more in ((k, 0), (s, (100 if s else 120))) if s < k and n > size else ((k, 0),):
            inside = [x for x in range(start, min(start + size, n)) if low[x] in asked]
            kinds = len({low[x] for x in inside})
            points = 1000 * kinds + len(inside) - kinds + more
            if points > best:
                best = points
                found = start if more else max(0, min(k - (size - (inside[-1] + 1 - k)) // 2, n - size))
    return found


def test_stretches_of_long_texts():
    """One sliding pass against looking at every stretch whole, the longest of 20,000 words."""
    r = random.Random(3)
    for n, size in [(0, 5), (1, 5), (5, 5), (6, 5), (40, 7), (300, 28), (300, 3), (20_000, 28)]:
        for often in (0.02, 0.3):
            text = "".join(("ask" + r.choice("abc") if r.random() < often else f"w{k}") + r.choice([" ", " ", ", ", ". ", ".", ": ", "\n"]) for k in range(n))
            asked = {"aska", "askb", "askc"}
            words = list(re.finditer(r"[^\W_]+", text))
            low = [m[0].lower() for m in words]
            at = [k for k, w in enumerate(low) if w in asked]
            if not at:
                continue
            sentences = [0] + [k for k in range(1, len(words)) if re.search(r"[.:][ \t\r\n]+$", text[words[k - 1].end() : words[k].start()])]
            if n < 1000:
                want = stretches(text, asked, size)
            else:  # looked at from a few words on each side of the place that was found, and nowhere better in a sample
                got = expand._best_stretch(at, [low[k] for k in at], sentences, len(words), size)
                points = lambda start: 1000 * len({low[x] for x in at if start <= x < start + size}) + sum(start <= x < start + size for x in at)
                assert all(points(got) + 130 >= points(k) - 3 for k in r.sample(at, 20))
                continue
            assert expand._best_stretch(at, [low[k] for k in at], sentences, len(words), size) == want


def test_telling_terms(spark):
    texts = [(k, "common pumping words" if k else "rare thing no") for k in range(10)]
    terms = spark.createDataFrame([("q", x) for x in ("common", "pumps", "rare", "no", "absent")], "query_id string, term string")
    got = {r.term for r in expand.telling(terms, spark.createDataFrame(texts, "id long, text string")).collect()}
    assert got == {"rare", "no", "absent"}


def test_mentions(spark):
    notes = [
        (1, "The Water Wheel turns. A water wheel again. `North Wing` and [[North Wing]] and http://x.org/Water\n## Water Wheel head\n```\nGranary\n```\nThe Granary stands by the old water wheel house."),
        (2, "granary lower, Granary upper, Common Common"), (3, "Common"), (4, "text of Common"), (5, "x"), (6, "Water Wheel links away"),
    ]
    names = [(10, "Water Wheel"), (11, "North Wing"), (12, "Granary"), (13, "Common"), (14, "Old Water Wheel House"), (15, "Barn"), (2, "Common Ground"), (6, "Water Wheel")]
    linked = spark.createDataFrame([(6, 10)], "id long, to_id long")
    df = spark.createDataFrame(notes, "id long, text string")
    got = {(r.id, r.to_id): r.at for r in expand.mentions(df, spark.createDataFrame(names, "to_id long, name string"), linked, 0.4).collect()}
    assert {k for k in got if k[0] == 1} == {(1, 6), (1, 12), (1, 14)} or {k for k in got if k[0] == 1} == {(1, 10), (1, 12), (1, 14)}
    assert (2, 12) in got and (3, 13) not in got and not [k for k in got if k[0] == 6]
    words = Counter(r.id for r in expand.mentions(df, spark.createDataFrame(names, "to_id long, name string"), linked, 1.0).collect())
    assert words[3] == 1 and max(words.values()) <= 3


def told_slowly(notes, names, shown):
    """Mentions in texts of plain words, each name looked for at each place."""
    out = set()
    for i, text in notes:
        words, places = text.split(), []
        for to, name in names:
            n = name.split()
            for at in range(len(words) - len(n) + 1):
                said = words[at : at + len(n)]
                if to != i and (said == n if len(n) == 1 else [x.lower() for x in said] == [x.lower() for x in n]):
                    places.append((-len(n), at, to, name))
        taken, kept = set(), {}
        for n, at, to, name in sorted(places):
            if not taken & set(range(at, at - n)):
                taken |= set(range(at, at - n))
                kept[to] = min(kept.get(to, (at, name)), (at, name))
        out |= {(i, to, name, at) for to, (at, name) in sorted(kept.items(), key=lambda x: x[1])[:shown]}
    return out


def test_mentions_against_brute_force(spark):
    """Names of one to fourteen words that overlap, in other case, and many to one beginning."""
    r = random.Random(5)
    for vocabulary in (["North", "north", "WATER", "Water", "wheel", "Granary"], ["Ärger", "ÄRGER", "Straße", "granary", "Σίσυφος", "ΣΊΣΥΦΟΣ"]):
        notes = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for k in range(40)]
        long = notes[0][1].split() or ["x"]
        names = sorted({(r.randint(0, 60), " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 2, 3, 4])))) for _ in range(60)} | {(99, " ".join((long * 14)[:14]))})
        names = [x for x in names if " " in x[1] or len(x[1]) >= 5]
        df = spark.createDataFrame(notes + [(100, None), (101, " ".join(["North", *(long * 14)[:14], "wheel"]))], "id long, text string")
        got = expand.mentions(df, spark.createDataFrame(names, "to_id long, name string"), spark.createDataFrame([], "id long, to_id long"), 1.0)
        want = told_slowly([x for x in [*notes, (101, " ".join(["North", *(long * 14)[:14], "wheel"]))]], names, 3)
        assert {(x.id, x.to_id, x.name, x.at) for x in got.collect()} == want and len(want) > 40
    none = spark.createDataFrame([], "to_id long, name string")
    assert expand.mentions(df, none, spark.createDataFrame([], "id long, to_id long")).count() == 0


def test_mentions_of_many_names_with_one_beginning(spark):
    """20,000 names begin with a word that every text says 2,000 times: places by names would be 4 billion."""
    notes = spark.range(100).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda k: F.concat(F.lit("the w"), (k * 100 + F.col("id")).cast("string"))), " ").alias("text"))
    names = spark.range(20_000).select((F.col("id") + 1000).alias("to_id"), F.concat(F.lit("The W"), (F.col("id") * 11).cast("string")).alias("name"))
    began = time.time()
    got = expand.mentions(notes, names, spark.createDataFrame([], "id long, to_id long")).collect()
    assert {x.id for x in got} == set(range(100)) and len(got) == 300
    assert time.time() - began < 40
