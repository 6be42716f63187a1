"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import chat, decontaminate, jaccard, language, pieces, quality, substrings, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
BASE = " ".join(f"t{k}" for k in range(120))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a b c d e f g h"), (8, LONG), (9, LONG),
    (10, LONG + " tail"), (11, BASE), (12, BASE + " end"), (13, "head " + BASE), (14, "q r s. " + BASE[:200] + " q r s"),
    (15, BASE), (15, BASE), (16, "x y " * 40), (17, "x y " * 41), (18, "äöü ß — 東京 " * 9), (None, "zz yy xx ww vv uu"), (19, "t5 t6"),
]
CLASHING = "doc_id long, text string, h long, cls long, n long, block string, lang string, source string, item_id string, count int"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, x, 1, 2, 3, "b", "en", None, "i", 4) for k, x in TEXTS], CLASHING)


def shingles(x):
    w = WORD.findall(lower(x or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(spark, docs):
    sets = [shingles(x) for _, x in TEXTS]
    up = list(range(len(TEXTS)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(TEXTS)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                up[top(a)] = top(b)
    least = {}
    for k, (doc_id, _) in enumerate(TEXTS):
        least[top(k)] = min((x for x in (least.get(top(k)), doc_id) if x is not None), default=None)
    want = Counter((doc_id, len(sets[k]), least[top(k)]) for k, (doc_id, _) in enumerate(TEXTS))
    assert Counter(map(tuple, jaccard.similar_groups(docs).collect())) == want
    assert jaccard.similar_groups(docs.limit(0)).collect() == []


def test_jaccard_chain_of_edits(spark):
    """A group of edited copies, each near the next only, is one component."""
    words = [f"c{k}" for k in range(200)]
    rows = []
    for k in range(40):
        rows.append((100 + k, " ".join(words)))
        words[(k * 5) % 200] = f"n{k}"
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {100}


def test_substrings(spark, docs):
    rows = [(k, x) for k, x in TEXTS if k is not None]
    rows = list(dict.fromkeys(rows))
    seen, want = set(), []
    for doc_id, x in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(x or "")
        hit = [False] * len(w)
        for k in range(len(w) - 19):
            one = tuple(w[k : k + 20])
            if one in seen:
                hit[k : k + 20] = [True] * 20
            seen.add(one)
        kept = " ".join(a for a, b in zip(w, hit) if not b)
        want.append((doc_id, len(w), sum(hit), kept))
    df = spark.createDataFrame([(k, x, 1, 2, 3) for k, x in rows], "doc_id long, text string, h long, n long, level int")
    got = substrings.without_repeats(df).select("doc_id", "n_words", "n_removed", "kept")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert substrings.without_repeats(df.limit(0)).collect() == []
    assert substrings.without_repeats(docs).count() == len(TEXTS)


def test_decontamination(spark, docs):
    items = [("i1", " ".join(f"T{k}" for k in range(30, 60))), ("i2", "q r s"), ("i3", None), ("i4", ""), ("i5", "absent words here"), ("i2", "q r s"), ("i6", "東京")]
    want = Counter()
    for doc_id, x in TEXTS:
        w = ITEM_WORD.findall(lower(x or ""))
        hit, ids = [False] * len(w), set()
        for item, text in items:
            t = ITEM_WORD.findall(lower(text or ""))
            for size in [min(13, len(t))] if t else []:
                for k in range(len(t) - size + 1):
                    for at in range(len(w) - size + 1):
                        if w[at : at + size] == t[k : k + size]:
                            ids.add(item)
                            hit[at : at + size] = [True] * size
        n = sum(hit)
        want[(doc_id, len(w), n, len(ids), n > 0 and 20 * n >= len(w))] += 1
    small = docs.where("doc_id is null or doc_id not in (8, 9, 10)")
    want = Counter({k: v for k, v in want.items() if k[0] not in (8, 9, 10)})
    bench = spark.createDataFrame([(*r, "t") for r in items], "item_id string, text string, doc_id string")
    got = decontaminate.contamination(small, bench)
    assert Counter((r.doc_id, r.n_words, r.n_hit, len(r.items), r.contaminated) for r in got.collect()) == want
    assert decontaminate.contamination(docs.limit(0), bench).collect() == []
    none = decontaminate.contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(TEXTS) and not any(r.contaminated for r in none)


def test_language(spark):
    words = {"en": "the and of that with for this from", "de": "der und die nicht mit das auch eine", "fr": "les des une dans que pour sur avec"}
    rows = [(k, " ".join(words[lang].split()[k % 5 :] + words[lang].split()[: k % 3]), lang) for k, lang in enumerate(list(words) * 60)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 --", "en"), (903, "der und die das", None), (904, "the of and that " * 20_000, None), (None, "les des une", None)]
    df = spark.createDataFrame([(*r, 0.5, "c") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r.doc_id: r for r in language.identified(df, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902))
    assert got[903].lang_pred == "de" and got[904].lang_pred == "en" and got[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[k].lang_pred == lang for k, _, lang in rows[:180]) >= 178
    assert language.identified(df.limit(0), ["doc_id"]).collect() == []
    unlabelled = language.identified(df.withColumn("lang", df["lang_pred"].substr(0, 0)).selectExpr("doc_id", "text", "cast(null as string) as lang"), ["doc_id"])
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    got = language.op1_language_id(spark, "/root/testdata/sf0.01").where("held_out and lang_pred <> 'und'")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").where("lang is not null")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_pieces(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = [x for _, x in TEXTS] + ["  two  spaces ", "\n\t", "🙂", "▁▁ marks ▁a", "z" * 3000, "a" * 70 + " b", "naïve CAFÉ", "\u200b x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pieces.encoded(df, ["doc_id"])
    got = {r.doc_id: r.ids for r in rows.collect()}
    assert got == {k: None if x is None else library.encode(x) for k, x in enumerate(texts)}
    back = {r.doc_id: r.text for r in pieces.decoded(rows, ["doc_id"]).collect()}
    for k, x in enumerate(texts):
        assert back[k] == (None if x is None else x.replace("▁", " ")), k
    assert pieces.encoded(df.limit(0), ["doc_id"]).collect() == []


def test_stream_commits_in_a_bounded_window():
    v = pieces.codec(pieces.model_path()).v
    stream, out, most = pieces.Stream(v), [], 0
    text = pieces.SPACE + LONG.replace(" ", pieces.SPACE)[:40_000]
    for k in range(0, len(text), 100):
        out += stream.feed(text[k : k + 100])
        most = max(most, len(stream.chars))
    out += stream.feed("", end=True)
    assert "".join(out) == text
    assert most <= 400


def test_pieces_query(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = dict(map(tuple, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()))
    for r in pieces.op6_sentencepiece(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[r.doc_id] or "")
        assert r.n_pieces == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest()


def test_urls(spark):
    link = '<a href="http://good.org/fr/x">x</a> <a href=http://bad.net/>y</a>'
    rows = [
        (1, None, None), (2, "", ""), (3, "no scheme", link), (4, "http://A.Org/fr/x?y#z", link), (5, "http://bad.net", None), (6, "http://www.example.net/en/a", link),
        (7, "http://example.com/de/a://b", ""), (8, "http://myexample.com/de/", ""), (9, "http://friend.com/p#q", link), (9, "http://friend.com/p#q", link), (10, "x://h?a/b", None),
    ]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, host string, rule string")
    got = urls.filtered(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule) == ("", "", None) and (by[3].host, by[3].path) == ("", "")
    assert (by[4].host, by[4].path, by[4].rule, by[4].verdict) == ("a.org", "/fr/x", "org/fr/", "allow")
    assert by[6].rule == "example.net/en/" and by[6].verdict == "allow"
    assert by[7].rule == "example.com/de/" and by[7].verdict == "block" and by[7].path == "/de/a://b"
    assert by[8].rule is None and (by[10].host, by[10].path) == ("h", "")
    # no path: a rule for net/ asks for one
    assert by[5].path == "" and by[5].rule is None
    assert urls.filtered(df.limit(0)).collect() == []


def test_url_links_in_any_case_and_without_scheme(spark):
    html = "<A HREF='//One.org/x'>x</A> <a Href=HTTP://two.org/y>y</a> <a href=\"/z//w\">z</a> <a href='//u.org?q=a://three.org'>u</a>"
    df = spark.createDataFrame([("h", html)], "host string, html string")
    assert {(r.a, r.b, r.w) for r in urls.links(df).collect()} == {("h", "one.org", 1), ("h", "two.org", 1), ("h", "u.org", 1)}


def test_language_sample_keeps_every_language(spark, monkeypatch):
    monkeypatch.setattr(language, "ROWS", 64)
    rows = [(k, f"text number {k}", f"l{k % 20}") for k in range(8000)] + [(9000 + k, f"rare {k}", "rare") for k in range(3)]
    rows += [(9100 + k, "1 " * 9 + "long words " * 3000 + "qqq", "long") for k in range(4)]
    known, langs = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(langs) == {r[2] for r in rows} and len(langs) == 64
    assert all("qqq" in x for x, lang in zip(known, langs) if lang == "long")  # whole texts are learned from


def test_quality(spark, docs):
    got = quality.judged(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        if r.doc_id in (1, 2, 3):
            assert r.n_words == 0 and r.base_failed and not r.kept
        if r.doc_id == 16:
            assert r.n_repeat_words == 80 and r.base_failed


def messages(spark, rows):
    return spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, depth int, h string")


def test_chat(spark):
    rows = [
        (1, 0, "user", "Where is the long red boat?\n\nAnd the second passage here."),
        (1, 1, "assistant", "> where is the   LONG red boat?\nIn the harbour of the town."),
        (1, 2, "user", ">> where is the long red boat?\n> In the harbour of the town.\n\nThanks a lot for that!"),
        (1, 3, "user", "> And the second passage here.\n\nYes, what of it?"),
        (2, 0, "user", "> In the harbour of the town.\nQuoted from elsewhere."),
        (2, 1, None, None), (2, 2, "user", ""), (3, 0, "user", "> nobody ever wrote this line\nok"), (None, 1, "user", "x"), (4, 5, "user", "> " + "y" * 100_000),
        (2, 1, None, None),
    ]
    got = chat.conversations(messages(spark, rows))
    by = defaultdict(list)
    for r in got.collect():
        by[r.conv_id, r.turn].append(r)
    assert sum(map(len, by.values())) == len(rows) - 1
    one = {k: v[0] for k, v in by.items()}
    parent = {k: (r.parent_conv, r.parent_turn, r.linked_by) for k, r in one.items()}
    assert parent[1, 0] == (None, None, "start") and parent[1, 1] == (1, 0, "quote")
    assert parent[1, 2] == (1, 1, "quote") and parent[1, 3] == (1, 0, "quote")
    assert parent[2, 0] == (1, 1, "quote") and parent[2, 1] == (2, 0, "order") and parent[3, 0][2] == "start"
    assert (one[2, 2].root_conv, one[2, 2].root_turn, one[2, 2].depth) == (1, 0, 4)
    assert one[1, 1].content == "In the harbour of the town." and one[1, 2].n_quotes == 2 and one[2, 1].content == ""
    assert len(by[2, 1]) == 2
    assert chat.conversations(messages(spark, rows).limit(0)).collect() == []


def test_chat_short_partial_and_far_quotes(spark):
    rows = [
        (1, 0, "u", "Yes, ok"), (1, 1, "u", "first line of a paragraph\nsecond line of the paragraph\nthird"), (1, 2, "u", "no"),
        (1, 3, "u", "> Yes, ok\nfine"), (1, 4, "u", "> second line of the paragraph\nwhy?"), (1, 5, "u", "> third\n> unheard of"),
        (2, 0, "u", "> written in a larger conversation\nso?"), (3, 0, "u", "Yes, ok"), (3, 1, "u", "> no\nhere no is too short"),
        (9, 0, "u", "well"), (9, 1, "u", "written in a larger conversation"),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.conversations(messages(spark, rows)).collect()}
    parent = {k: (r.parent_conv, r.parent_turn, r.linked_by) for k, r in got.items()}
    assert parent[1, 3] == (1, 0, "quote") and parent[1, 4] == (1, 1, "quote") and parent[1, 5] == (1, 1, "quote")
    assert parent[2, 0] == (9, 1, "quote") and parent[3, 1] == (3, 0, "order")
    assert (got[2, 0].root_conv, got[2, 0].root_turn, got[2, 0].depth) == (9, 0, 2) and got[1, 5].n_quotes == 1


def test_chat_rings(spark):
    """Each of the conversations 1 to 5 quotes the next and 5 quotes 1; 6 quotes into the ring; 7 and 8 quote each other."""
    wrote = lambda k: f"what conversation {k} has written"
    rows = [(k, 3, "u", f"> {wrote(k % 5 + 1)}\n{wrote(k)}") for k in range(1, 6)] + [(6, 0, "u", f"> {wrote(3)}\nx")]
    rows += [(7, 0, "u", f"> {wrote(8)}\n{wrote(7)}"), (8, 0, "u", f"> {wrote(7)}\n{wrote(8)}")]
    got = {r.conv_id: r for r in chat.conversations(messages(spark, rows)).collect()}
    assert {k: r.parent_conv for k, r in got.items()} == {1: None, 2: 3, 3: 4, 4: 5, 5: 1, 6: 3, 7: None, 8: 7}
    assert {k: (r.root_conv, r.depth) for k, r in got.items()} == {1: (1, 0), 2: (1, 4), 3: (1, 3), 4: (1, 2), 5: (1, 1), 6: (1, 4), 7: (7, 0), 8: (7, 1)}


def test_chat_query(spark):
    rows = chat.op8_chat_format(spark, "/root/testdata/sf0.01").collect()
    place = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").count()
    for r in rows:
        assert not any(x.lstrip(" \t").startswith(">") for x in r.content.split("\n"))
        up = place.get((r.parent_conv, r.parent_turn))
        assert (r.linked_by == "start") == (up is None)
        if up is not None:
            assert r.depth == up.depth + 1 and (r.root_conv, r.root_turn) == (up.root_conv, up.root_turn)


def test_warc(spark):
    big = "<p>" + "é" * 2000 + "</p>"
    rows = [(1, "http://a.b/c", big), (2, "http://A.b/d", big), (3, None, None), (4, "x", ""), (5, "http://z.y", "short"), (6, "http://z.y", "short"), (7, "http://a.b/c", big)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, payload_digest string, offset int")
    _, index, folder = warc.archived(spark, df)
    rows_read = warc.lookup(df.select(warc.capture_key(F.col("url")).alias("key")), index, folder).collect()
    got = {r.page_id: r for r in rows_read}
    assert len(rows_read) == len(rows) and got[1].payload is None and got[7].payload == big.encode()
    for k, _, html in rows:
        data = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert [(k, got[k].record_type, got[k].refers_to) for k in (1, 2, 7)] == [(1, "revisit", 7), (2, "revisit", 7), (7, "response", None)]
    assert all(got[k].record_type == "response" for k in (3, 4, 5, 6))


def test_each_index_file_is_read_once(spark, monkeypatch, tmp_path):
    """Forty index files, keys that several of them hold, and keys that none does: a task reads a directory once."""
    import pyarrow as pa

    from lodestar.llm import warc

    pages = [(k, f"http://h{k % 300:03d}.org/{k % 7}", f"<p>{k}</p>") for k in range(1500)] + [(k, "http://hot.org/", "<p>hot</p>" * 200) for k in range(2000, 2400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        _, index, folder = warc.archived(spark, df, f"file://{tmp_path}/warc")
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    files = sorted(map(tuple, index.select("file", "first_key", "last_key", "bytes").collect()), key=lambda x: (x[1], x[2]))
    assert len(files) > 30
    keys = sorted({r.key for r in df.select(warc.capture_key(F.col("url")).alias("key")).collect()} | {"zzz", "a"})
    reads = []
    tail = warc._Reader.tail
    monkeypatch.setattr(warc._Reader, "tail", lambda self, name: reads.append(name) or tail(self, name))
    told = type("Told", (), {"value": files})
    batches = (pa.RecordBatch.from_arrays([pa.array(keys[k : k + 50])], ["key"]) for k in range(0, len(keys), 50))
    found = [x for b in warc._find(told, folder)(batches) for x in b.to_pylist()]
    assert len(reads) == len(set(reads)) <= len(files) and {x["key"] for x in found} >= set(keys) - {"zzz", "a"}
    got = warc.lookup(spark.createDataFrame([(k,) for k in keys], "key string"), index, folder)
    assert sorted(r.page_id for r in got.select("page_id").collect()) == sorted(p[0] for p in pages)
    hot = {r.page_id: (r.record_type, r.refers_to) for r in got.where("page_id >= 2000").collect()}
    assert hot == {k: ("revisit", 2399) for k in range(2000, 2399)} | {2399: ("response", None)}
