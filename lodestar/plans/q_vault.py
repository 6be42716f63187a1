"""Queries over notes as they are written: documents are composed to Markdown with frontmatter and links, and parsed."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import TOKEN, first_words, query_terms, tokens
from ..lineage import cut, dropped, kept
from ..operators import changes as C
from ..operators import context as X
from ..operators import dates as DT
from ..operators import expand as E
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import writers
from ..registry import query
from ..sources import cases, imports, memory, vault
from .views import NOTES, POSTINGS, QUESTIONS, notes, questions, table, terms_sql

TODAY = "2025-03-01"


def raw_notes(spark, d):
    """(id, raw, day): every document as a Markdown file that links to two others."""
    docs = table(spark, d, "documents")
    n = docs.agg(F.count("*").alias("n"))  # one number
    title = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), 1, 3), " ")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd")
    to = lambda a, b: ((F.col("doc_id") * a + b) % F.col("n")).cast("string")
    raw = F.concat(
        F.lit('---\ntitle: "'), F.coalesce(title, F.lit("")), F.lit('"\ntype: '), F.when(F.col("doc_id") % 17 == 0, "hub").otherwise("note"), F.lit('\nproject: "[['), F.coalesce("source", F.lit("none")),
        F.lit(']]"\ntopics:\n  - "[['), F.coalesce("lang", F.lit("none")), F.lit(']]"\nmodified: '), day, F.lit("\n---\n"), F.coalesce("text", F.lit("")),
        F.lit("\n\nIt builds on [[notes/"), to(7, 3), F.lit("]] in many ways.\n\n- [[notes/"), to(13, 5), F.lit("]]\n"),
    )
    return docs.crossJoin(F.broadcast(n)).select(F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("id"), raw.alias("raw"), F.lit("2024-01-01").alias("day"))


_VAULT = r"""n AS (SELECT count(*) AS n FROM documents), vault AS (
  SELECT 'notes/' || doc_id || '.md' AS id, doc_id, coalesce(nullif(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+')[1:3], ' '), ''), CAST(doc_id AS VARCHAR)) AS title,
    CASE WHEN doc_id % 17 = 0 THEN 'hub' ELSE 'note' END AS type, coalesce(source, 'none') AS project, coalesce(lang, 'none') AS topic,
    strftime(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER), '%Y-%m-%d') AS modified, 'notes/' || ((doc_id * 7 + 3) % n) AS k1, 'notes/' || ((doc_id * 13 + 5) % n) AS k2
  FROM documents, n)"""


def parsed(spark, d):
    return vault.parsed(raw_notes(spark, d))


@query(f"WITH {_VAULT} SELECT id, title, type, project, modified, topic AS topics, concat_ws('|', project, topic, k1, CASE WHEN k2 <> k1 THEN k2 END) AS links FROM vault")
def parse_note(spark, d):
    return vault.notes(parsed(spark, d)).select("id", "title", "type", "project", "modified", F.array_join("topics", "|").alias("topics"), F.array_join("links", "|").alias("links"))


@query(f"""WITH {_VAULT} SELECT id AS from_id, 0 AS pos, 'fm' AS kind, 'project' AS fm_key, project AS target, NULL AS ctx FROM vault UNION ALL SELECT id, 1, 'fm', 'topics', topic, NULL FROM vault
UNION ALL SELECT id, 2, 'sentence', NULL, k1, 'It builds on ' || k1 || ' in many ways.' FROM vault UNION ALL SELECT id, 3, 'list_bare', NULL, k2, k2 FROM vault""")
def link_occurrences(spark, d):
    """Every link of every note with its kind, in order."""
    return vault.edges(parsed(spark, d)).select("from_id", "pos", "kind", "fm_key", "target", "ctx")


@query()
def section_windows(spark, d):
    return vault.sections(parsed(spark, d)).select("id", "ord", "heading", "level", F.length("text").alias("size"), F.sha1("text").alias("sha1"))


@query()
def link_windows(spark, d):
    return vault.edges(parsed(spark, d)).where("kind <> 'fm'").select("from_id", "pos", "from_ord")


@query(f"WITH {_VAULT} SELECT DISTINCT name, id FROM (SELECT lower(title) AS name, id FROM vault UNION ALL SELECT CAST(doc_id AS VARCHAR), id FROM vault)")
def titles(spark, d):
    return vault.titles(parsed(spark, d))


@query(f"WITH {_VAULT} SELECT DISTINCT id AS from_id, lower(t) AS target FROM (SELECT id, unnest([project, topic, k1, k2]) AS t FROM vault)")
def link_targets(spark, d):
    return vault.links(parsed(spark, d))


@query(f"WITH {_VAULT} SELECT id, title, modified FROM vault WHERE type = 'hub' ORDER BY modified DESC, id LIMIT 50")
def hubs(spark, d):
    """The first page of the hubs."""
    return parsed(spark, d).where("type = 'hub'").orderBy(F.desc("modified"), "id").limit(50).select("id", "title", "modified")


@query(f"WITH {_VAULT} SELECT id, title FROM vault WHERE topic = 'fr' AND project = 'src1'")
def topic_notes(spark, d):
    """Notes of a project that have a topic, in any case."""
    topics = parsed(spark, d).select("id", F.explode("topics").alias("t")).where(F.lower("t") == "fr").select("id")
    return parsed(spark, d).where(F.lower("project") == "src1").join(topics, "id", "left_semi").select("id", "title")


@query(f"""WITH {_VAULT}, r AS (SELECT doc_id AS ref, CASE doc_id % 4 WHEN 0 THEN id WHEN 1 THEN 'notes/' || doc_id WHEN 2 THEN upper(id) ELSE lower(title) END AS name FROM vault),
c AS (SELECT ref, id, 0 AS prio FROM r JOIN vault ON id = name UNION ALL SELECT ref, id, 1 FROM r JOIN vault ON id = name || '.md' UNION ALL SELECT ref, id, 2 FROM r JOIN (SELECT lower(id) AS l, min(id) AS id FROM vault GROUP BY 1) ON l = lower(name)
  UNION ALL SELECT ref, id, 3 FROM r JOIN (SELECT lower(title) AS l, first(id ORDER BY type = 'hub' DESC, modified DESC, id) AS id FROM vault GROUP BY 1) ON l = lower(name))
SELECT ref, first(id ORDER BY prio) AS id FROM c GROUP BY ref""")
def resolve_name(spark, d):
    """What a name means: an id, an id without .md, an id in any case, then a title, of several hubs first and the latest."""
    v = cut(vault.notes(parsed(spark, d)).select("id", "title", "type", "modified"))  # read several times, parsed once
    k = F.regexp_extract("id", r"(\d+)", 1).cast("long")
    r = v.select(k.alias("ref"), F.when(k % 4 == 0, F.col("id")).when(k % 4 == 1, F.regexp_replace("id", r"\.md$", "")).when(k % 4 == 2, F.upper("id")).otherwise(F.lower("title")).alias("name"))
    low = v.groupBy(F.lower("id").alias("l")).agg(F.min("id").alias("to"))
    # each name is reduced to its best note before anything is joined
    by_title = v.groupBy(F.lower("title").alias("l")).agg(F.min_by("id", F.struct(F.col("type") != "hub", -F.unix_date(F.to_date("modified")), "id")).alias("to"))
    keys = v.select(F.struct(F.lit(0).alias("prio"), "id").alias("c"), F.col("id").alias("key")).union(v.select(F.struct(F.lit(1), "id"), F.regexp_replace("id", r"\.md$", "")))
    found = r.join(keys, r["name"] == keys["key"]).select("ref", "c").union(r.join(low, F.lower("name") == F.col("l")).select("ref", F.struct(F.lit(2), "to"))).union(
        r.join(by_title, F.lower("name") == F.col("l")).select("ref", F.struct(F.lit(3), "to"))
    )
    return found.groupBy("ref").agg(F.min("c").alias("c")).select("ref", F.col("c.id").alias("id"))


# Memory: a customer's orders are the blocks of a note, two orders of a day share a stamp.
_DAY = "strftime(o_orderdate, '%Y-%m-%d') || ' 00:00'"
_WORD = "regexp_replace(lower(o_orderpriority), '[^a-z]', '', 'g')"


def memory_notes(spark, d):
    """(id, body): the memory note of each customer, written by rendered() in order of the orders."""
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00"))
    word = F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]", "")
    fact = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" is "), "o_orderstatus", F.lit("."))
    labels = {
        "Why": F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("total "), F.round("o_totalprice").cast("long").cast("string"))), "Key": F.concat(F.lit("order / "), F.col("o_orderstatus")),
        "Replaces": F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.date_format(F.date_sub("o_orderdate", 1), "yyyy-MM-dd"), F.lit(" 00:00 #2"))),
    }
    one = memory.rendered(stamp, word, fact, labels, F.lit("shop"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", one.alias("block"))
    body = F.concat(F.lit("# Memory\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "block"))), lambda x: x["block"]), "\n"))
    return rows.groupBy(F.col("o_custkey").alias("id")).agg(body.alias("body"))


_BLOCKS = f"""blocks AS (SELECT o_custkey AS note, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, {_DAY} AS stamp, {_WORD} AS category, o_orderkey, o_orderstatus, o_totalprice, o_orderdate,
  row_number() OVER (PARTITION BY o_custkey, {_DAY} ORDER BY o_orderkey) AS k FROM orders)"""


@query(f"WITH {_BLOCKS} SELECT note, ord, CASE WHEN k > 1 THEN stamp || ' #' || k ELSE stamp END AS id, category FROM blocks")
def memory_blocks(spark, d):
    return memory.blocks(memory_notes(spark, d)).select("note", F.col("ord").cast("long").alias("ord"), "id", "category")


@query(f"""WITH {_BLOCKS} SELECT note, ord, 'Order ' || o_orderkey || ' is ' || o_orderstatus || '.' AS fact, CASE WHEN o_orderkey % 3 = 0 THEN 'total ' || CAST(round(o_totalprice) AS BIGINT) END AS why, 'order' AS subject, o_orderstatus AS attribute,
  CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') || ' 00:00 #2' ELSE '' END AS replaces, 'mcp:shop' AS via FROM blocks""")
def block_fields(spark, d):
    rows = memory.block_fields(memory.blocks(memory_notes(spark, d)))
    return rows.select("note", F.col("ord").cast("long").alias("ord"), "fact", "why", "subject", "attribute", F.array_join("replaces", "|").alias("replaces"), "via")


@query(f"WITH {_BLOCKS} SELECT note, ord + 1 AS ord, CASE WHEN k > 1 THEN stamp || ' #' || k ELSE stamp END AS fact FROM blocks UNION ALL SELECT DISTINCT o_custkey, 0, NULL FROM orders")
def section_fact_id(spark, d):
    """The fact that each section of a memory note tells of; the first section is the title's."""
    raw = memory_notes(spark, d).select(F.col("id").cast("string").alias("id"), F.col("body").alias("raw"), F.lit("2024-01-01").alias("day"))
    return memory.section_facts(vault.sections(vault.parsed(raw))).select(F.col("id").cast("long").alias("note"), F.col("ord").cast("long").alias("ord"), "fact")


# Every fortieth customer's question names the days of its first two orders and something that is no date.
_DAYS = r"""firsts AS (SELECT o_custkey AS query_id, [strftime(d, '%Y-%m-%d') for d in list(o_orderdate ORDER BY o_orderkey)[1:2]] AS days FROM orders WHERE o_custkey % 40 = 0 GROUP BY o_custkey),
wanted AS (SELECT query_id, unnest(days) AS date, unnest(range(len(days))) AS nth FROM firsts),
held AS (SELECT o_custkey AS note, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey, o_orderdate FROM orders),
said AS (SELECT DISTINCT CAST(note AS VARCHAR) AS note, ord, date FROM (SELECT note, ord, date FROM held UNION ALL SELECT note, ord, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') FROM held WHERE o_orderkey % 5 = 0)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY note, ord) AS no FROM said SEMI JOIN wanted USING (date)) WHERE no <= 40)"""


@query(f"WITH {_DAYS} SELECT query_id, note, ord::BIGINT AS ord, date, row_number() OVER (PARTITION BY query_id ORDER BY nth, no) AS rank FROM wanted JOIN best USING (date)")
def exact_date_hits(spark, d):
    """Sections of the memory notes that hold the dates of a question word for word, forty a date."""
    raw = memory_notes(spark, d).select(F.col("id").cast("string").alias("id"), F.col("body").alias("raw"), F.lit("2024-01-01").alias("day"))
    held = vault.sections(vault.parsed(raw)).select(F.col("id").alias("note"), F.col("ord").cast("long").alias("ord"), "text")
    days = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderdate"))), 1, 2), lambda x: F.date_format(x["o_orderdate"], "yyyy-MM-dd"))
    asked = table(spark, d, "orders").where("o_custkey % 40 = 0").groupBy(F.col("o_custkey").alias("query_id")).agg(days.alias("days"))
    text = F.concat(F.lit("What was ordered on "), F.array_join("days", " or "), F.lit("? Not on x1999-01-01 or 1999-1-1."))
    got = DT.date_hits(DT.date_index(held), asked.select("query_id", DT.dates_of(text).alias("dates")))
    return got.select("query_id", "note", "ord", "date", F.col("rank").cast("long").alias("rank"))


@query()
def remember_verdict(spark, d):
    """Every twentieth document as a new fact beside all others: refused, held or stored."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), F.slice(query_terms(F.col("text")), 1, 1 << 20).alias("terms"), (F.col("doc_id") % 20 == 0).alias("new"))
    current = docs.where("not new").select("id", "category", F.lit(None).cast("string").alias("key"), "terms")
    new = docs.where("new").select("id", "category", F.lit(None).cast("string").alias("key"), "terms", F.array().cast("array<string>").alias("named"), F.lit(False).alias("force"))
    return memory.remembered(new, current).select("id", "verdict", "match")


@query()
def dedupe_titles(spark, d):
    rows = notes(spark, d).select(F.col("path"), F.col("title"), F.coalesce("project", F.lit("")).alias("hint"))
    return imports.unique_titles(rows)


@query(f"""SELECT item_id AS id, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split('{cases.SALT}' || item_id, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)) % 4 = 0 AS dev FROM benchmark""")
def fnv_split(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), (cases.fnv1a(F.concat(F.lit(cases.SALT), F.col("item_id").cast("string"))) % 4 == 0).alias("dev"))


@query()
def eval_evidence(spark, d):
    """Of each question's words of six letters or more in threes those groups that its best note holds."""
    w = F.filter(tokens(F.col("text")), lambda x: F.length(x) >= 6)
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - 1) / 3).cast("int"))), lambda k: F.slice(w, k * 3 + 1, F.lit(3)))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), groups.alias("evidence"))
    from .q_retrieval import lexical

    best = lexical(spark, d, 1).join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), "key").select(F.col("query_id").alias("id"), "text")
    return cases.covered(asked, best)


def vocab(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df"))


@query()
def stemmed_search(spark, d):
    """The forty best by stems of words without diacritics."""
    from .q_retrieval import TEXT, words

    # each word once, whatever the texts that have it
    known = table(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    forms, asked = E.stem_forms(known, questions(spark, d))
    got = R.ranked(R.bm25(words(spark, d), asked, TEXT, forms), most=40)
    return got.select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(rf"""WITH {POSTINGS}, {QUESTIONS}, asked AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM questions),
v AS (SELECT DISTINCT term FROM postings), m AS (SELECT DISTINCT a.term AS form, v.term FROM (SELECT DISTINCT term FROM asked) a JOIN v ON starts_with(v.term, a.term)),
h AS (SELECT DISTINCT form, key FROM m JOIN postings USING (term))
SELECT query_id, key FROM asked JOIN h ON h.form = asked.term GROUP BY query_id, key HAVING count(DISTINCT form) = (SELECT len(terms) FROM questions q WHERE q.query_id = asked.query_id)""")
def prefix_search(spark, d):
    """Documents that have a word with each term of the question as its beginning."""
    from .q_retrieval import TEXT, words

    q = questions(spark, d)
    got = R.bm25(words(spark, d), q, TEXT, E.prefix_forms(vocab(spark, d), q)).join(q.select("query_id", F.size("terms").alias("n")), "query_id")
    return got.where("matched = n").select("query_id", "key")


def misspelt(spark, d):
    """Words of the questions with two neighbouring letters swapped."""
    w = table(spark, d, "benchmark").select(F.explode(query_terms(F.col("text"))).alias("w")).distinct().where("length(w) >= 6")
    return w.select(F.concat(F.left("w", F.lit(2)), F.substring("w", 4, 1), F.substring("w", 3, 1), F.expr("substring(w, 5)")).alias("term"))


@query()
def spell_correct(spark, d):
    return E.corrections(misspelt(spark, d), vocab(spark, d))


ALIASES = {"data": "dataset table", "model": "network", "machine learning": "training"}


@query(rf"""WITH q AS (SELECT item_id AS query_id, lower(text) AS low, {terms_sql("text")} AS terms FROM benchmark)
SELECT query_id, array_to_string(list_filter(x, lambda t, i: list_position(x, t) = i), ' ') AS terms FROM (SELECT query_id, list_concat(list_concat(terms, flatten(list_transform(terms, lambda t: CASE t WHEN 'data' THEN ['dataset', 'table'] WHEN 'model' THEN ['network'] ELSE [] END))), CASE WHEN contains(low, 'machine learning') THEN ['training'] ELSE [] END) AS x FROM q)""")
def expand_terms(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", query_terms(F.col("text")).alias("terms"))
    none = spark.createDataFrame([], "term string, correction string")
    return E.expanded(q, ALIASES, none, none.select("term")).select("query_id", F.array_join("terms", " ").alias("terms"))


@query()
def snippets(spark, d):
    """Where each of the best notes of a question answers it."""
    from .q_retrieval import lexical

    rows = lexical(spark, d, 10).join(questions(spark, d), "query_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), "key")
    return rows.select("query_id", "key", E.snippet(F.col("text"), F.col("terms")).alias("snippet"))


@query(rf"""WITH {QUESTIONS}, t AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM questions), w AS (SELECT DISTINCT term FROM t), x AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws FROM documents),
df AS (SELECT term, count(*) AS df FROM w, x WHERE CASE WHEN length(term) >= 4 THEN contains(low, left(term, greatest(4, length(term) - 1))) ELSE list_contains(ws, term) END GROUP BY term)
SELECT t.query_id, t.term FROM t LEFT JOIN df ON df.term = t.term WHERE coalesce(df, 0) <= 0.4 * (SELECT count(*) FROM documents)""")
def topic_filter(spark, d):
    """Terms of the questions that tell documents apart."""
    terms = questions(spark, d).select("query_id", F.explode("terms").alias("term")).distinct()
    return E.telling(terms, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")).select("query_id", "term")


@query()
def unlinked_mentions(spark, d):
    """Titles of other notes in the texts."""
    docs = table(spark, d, "documents")
    title = F.array_join(first_words(F.col("text"), 3), " ")
    n = docs.select(F.col("doc_id").alias("id"), title.alias("title"), F.col("text").alias("body"))
    names = n.where("title <> ''").groupBy("title").agg(F.min("id").alias("to_id")).select("to_id", F.col("title").alias("name"))
    linked = n.select("id", F.col("id").alias("to_id"))
    return E.mentions(n.select("id", F.col("body").alias("text")), names, linked)


def pack_inputs(spark, d):
    """Sections and notes of the parsed documents, and the hits of the questions in both."""
    v = kept(parsed(spark, d).select("id", "title", "type", "modified", "body", "sections", "edges"))
    sections = vault.sections(v)
    q = questions(spark, d)
    key = F.struct("id", "ord")
    rows = sections.select(key.alias("key"), tokens(F.col("heading")).alias("heading"), tokens(F.col("text")).alias("text"))
    n_terms = q.select("query_id", F.size("terms").alias("n_terms"))
    hits = R.strict_then_loose(R.bm25(rows, q, {"heading": 3.0, "text": 1.0}), n_terms, 5, 40).select("query_id", F.col("key.id").alias("note"), F.col("key.ord").alias("ord"), "rank")
    whole = v.select(F.col("id").alias("key"), tokens(F.col("title")).alias("title"), tokens(F.col("body")).alias("body"))
    by_note = R.strict_then_loose(R.bm25(whole, q, {"title": 4.0, "body": 1.0}), n_terms, 3, 15).select("query_id", F.col("key").alias("note"), "rank")
    ends = vault.edges(v).where("kind <> 'fm'").select(F.col("from_id").alias("a"), F.concat("target", F.lit(".md")).alias("b")).distinct()
    return v, sections, q, hits, by_note, ends


@query()
def context_lexical(spark, d):
    """The pack of sections for each question."""
    v, sections, q, hits, by_note, ends = pack_inputs(spark, d)
    ranked = X.lexical_candidates(q, hits, by_note, v, sections, ends, TODAY)
    got = cut(X.pack(ranked, sections).select("query_id", F.col("rank").cast("long").alias("rank"), "note", "ord", F.length("text").alias("size")))
    dropped(v)
    return got


@query()
def context_pack(spark, d):
    """Sections by keyword, note and exact words fused, packed and written out for each question."""
    v, sections, q, hits, by_note, _ = pack_inputs(spark, d)
    key = F.concat_ws("#", "note", "ord")
    lists = [hits.select("query_id", key.alias("key"), "rank"), by_note.select("query_id", F.concat("note", F.lit("#0")).alias("key"), "rank")]
    fused = R.fuse(lists).where("rank <= 24").select("query_id", F.regexp_extract("key", "^(.*)#", 1).alias("note"), F.regexp_extract("key", r"#(\d+)$", 1).cast("int").alias("ord"), "rank")
    got = cut(X.rendered(X.pack(fused, sections), v))
    dropped(v)
    return got


def current_facts(spark, d):
    """(id, title, type, modified, text): the current facts of the memory notes, a customer's orders each."""
    from .q_facts import at, facts
    from ..operators import facts as O

    f = facts(spark, d).where(O.status(at()) == "current")
    return f.select(
        F.col("id").cast("string").alias("id"), F.col("category").alias("title"), F.lit("fact").alias("type"), F.date_format("valid_from", "yyyy-MM-dd").alias("modified"),
        F.concat(F.lit("customer "), F.col("subject").cast("string"), F.lit(" since "), F.date_format("valid_from", "yyyy-MM-dd")).alias("text"),
    )


def bundle(spark, d, topic=None):
    v = cut(parsed(spark, d).select("id", "title", "type", "project", "modified", "topics", F.col("body").alias("text")))
    of = lambda p: v.where(F.col("project") == p)
    late = v.where((F.col("modified") >= "2025-01-20") & ~F.col("type").isin(*G.STRUCTURAL)).orderBy(F.desc("modified"), "id").limit(20)
    skills, hubs = (x.orderBy(F.desc("modified"), "id").limit(50) for x in (of("src2"), v.where("type = 'hub'")))
    return X.identity(v.where("id = 'notes/1.md'"), of("src0"), current_facts(spark, d), skills, hubs, late, topic=topic).select("part", "no", F.sha1("text").alias("sha1"))


@query()
def identity_sections(spark, d):
    """The owner's bundle of the parsed notes: a profile, a project's memory, current facts, skills, hubs and late changes."""
    return bundle(spark, d)


@query()
def identity_topic(spark, d):
    """The bundle with the memory that a topic is about: a word of the notes that not too many of them have, and one
    that says nothing."""
    return bundle(spark, d, "what about the ertion")


@query(f"""WITH {_VAULT}, l AS (SELECT id AS a, k || '.md' AS b FROM (SELECT id, unnest([k1, k2]) AS k FROM vault)), o AS (SELECT DISTINCT b AS other FROM l WHERE a = 'notes/3.md'), b AS (SELECT DISTINCT a AS other FROM l WHERE b = 'notes/3.md' AND a <> b)
SELECT 'out' AS part, '' AS "group", row_number() OVER (ORDER BY title, other) AS no, other, title FROM o JOIN vault ON id = other
UNION ALL SELECT 'back', project, row_number() OVER (PARTITION BY project ORDER BY modified DESC, other), other, title FROM b JOIN vault ON id = other
UNION ALL SELECT 'topics', topic, no, id, title FROM (SELECT topic, id, title, row_number() OVER (ORDER BY id) AS no FROM vault WHERE topic = (SELECT topic FROM vault WHERE id = 'notes/3.md') AND id <> 'notes/3.md') WHERE no <= 100""")
def graph_view(spark, d):
    v = cut(parsed(spark, d).select("id", "title", "project", "modified", "topics", "edges"))
    ends = vault.edges(v).where("kind <> 'fm'").select(F.col("from_id").alias("a"), F.concat("target", F.lit(".md")).alias("b"))
    got = X.graph_view("notes/3.md", ends, v.select("id", "title", "project", "modified"), v.select("id", F.explode("topics").alias("topic")))
    return got.withColumn("no", F.col("no").cast("long"))


@query(f"""WITH {_VAULT} SELECT v.id, v.title, concat_ws('|', a.title, CASE WHEN b.title <> a.title THEN b.title END) AS links FROM vault v JOIN vault a ON a.id = v.k1 || '.md' JOIN vault b ON b.id = v.k2 || '.md'""")
def read_note(spark, d):
    """Every note with the titles it links to."""
    v = parsed(spark, d)
    to = v.select(F.concat(F.regexp_replace("id", r"\.md$", "")).alias("target"), "title")
    ends = vault.edges(v).where("kind <> 'fm'").select(F.col("from_id").alias("a"), "pos", "target").join(to, "target").select("a", "pos", "title")
    return X.read_view(v.select("id", "title", "body"), ends).select("id", "title", F.array_join("links", "|").alias("links"))


@query()
def semantic_pca(spark, d):
    """The place of each note, forty of them, by the meaning of its vectors."""
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 40).alias("note"), F.col("embedding").alias("v"))
    return G.meaning(v)


@query()
def project_sem(spark, d):
    """The mean place of each label's notes and its colour."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("note"), F.col("embedding").alias("v"))
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("note"), F.col("label").cast("string").alias("project"))
    places = G.project_places(G.meaning(v).join(labels, "note"))
    return places.select("project", "sem", G.colour(F.col("sem"), F.lit(False)).alias("colour"))


@query("SELECT user_id, count(*) FILTER (value > 50) AS live, count(*) AS n FROM events GROUP BY user_id")
def live_per_client(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("live"), F.count("*").alias("n"))


@query(f"WITH {_VAULT} SELECT topic, string_agg(id, '|' ORDER BY modified DESC, id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY modified DESC, id) AS k FROM vault) WHERE k <= 20 GROUP BY topic")
def topic_lists(spark, d):
    """The twenty latest notes of each topic, in order."""
    rows = parsed(spark, d).select("id", "modified", F.explode("topics").alias("topic"))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("topic").orderBy(F.desc("modified"), "id"))).where("k <= 20")
    return rows.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]), "|").alias("ids"))


@query(f"WITH {NOTES} SELECT id, hypot_, round(angle, 9) AS angle FROM (SELECT id, round(sqrt(size * size + id * id), 6) AS hypot_, atan2(size, id + 1) AS angle FROM notes)")
def polar(spark, d):
    return notes(spark, d).select("id", F.round(F.hypot("size", "id"), 6).alias("hypot_"), F.round(F.atan2("size", F.col("id") + 1), 9).alias("angle"))


@query("""WITH s AS (SELECT doc_id AS id, 0 AS ord, left(text, 1500) AS input FROM documents), v AS (SELECT id, 0 AS ord, sha1(CASE WHEN id % 5 = 0 THEN 'old' ELSE input END) AS hash, CASE WHEN id % 7 = 0 THEN 'm0' ELSE 'm1' END AS model FROM s WHERE id % 3 <> 0)
SELECT s.id, s.ord, sha1(input) AS hash FROM s LEFT JOIN v ON v.id = s.id AND v.ord = s.ord WHERE hash IS NULL OR hash <> sha1(input) OR model <> 'm1'""")
def embed_missing(spark, d):
    """Sections whose vector is missing, of an old text or by another model."""
    s = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("ord"), F.left("text", F.lit(1500)).alias("input"))
    v = s.where("id % 3 <> 0").select("id", "ord", F.sha1(F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("input"))).alias("hash"), F.when(F.col("id") % 7 == 0, "m0").otherwise("m1").alias("model"))
    return C.to_embed(s, v, "m1").select("id", "ord", "hash")


@query("""WITH n AS (SELECT source AS id, count(*) AS n FROM documents GROUP BY source), v AS (SELECT id, unnest(range(n + 2)) AS ord FROM n UNION ALL SELECT 'gone', 0)
SELECT v.id, v.ord FROM v LEFT JOIN n ON n.id = v.id WHERE v.ord >= coalesce(n, 0)""")
def vector_orphans(spark, d):
    """Vectors beyond the last section of their note: two too many of each, and those of a note that is gone."""
    docs = table(spark, d, "documents").select(F.col("source").alias("id"))
    v = docs.groupBy("id").agg(F.count("*").alias("n")).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 1)).alias("ord")).union(spark.range(1).select(F.lit("gone"), F.lit(0).cast("long")))
    return C.orphans(v, docs)


@query("""WITH a AS (SELECT user_id, ts, value >= 30 AS ok, max(CASE WHEN value >= 30 THEN ts END) OVER (PARTITION BY user_id) AS last FROM events)
SELECT user_id, count(*) AS n FROM a WHERE NOT ok AND ts <= TIMESTAMP '2024-01-28' AND ts > TIMESTAMP '2024-01-14' AND (last IS NULL OR ts > last) GROUP BY user_id""")
def lockouts(spark, d):
    """Failures of the last two weeks since the last success of each user."""
    a = table(spark, d, "events").select("user_id", "ts", (F.col("value") >= 30).alias("ok"))
    return C.recent_failures(a, "user_id", F.lit("2024-01-28").cast("timestamp_ntz"), F.expr("INTERVAL 14 DAYS"))


@query(f"WITH {_VAULT} SELECT DISTINCT id AS from_id, k || '.md' AS to_id FROM (SELECT id, doc_id, unnest([k1, k2]) AS k FROM vault WHERE doc_id % 10 <> 0) WHERE CAST(regexp_extract(k, '[0-9]+') AS BIGINT) % 10 = 0")
def broken_links(spark, d):
    """Links of the notes that stay which lead nowhere once every tenth note is deleted."""
    v = cut(parsed(spark, d).select("id", "edges"))
    ends = vault.edges(v).where("kind <> 'fm'").select("from_id", F.concat("target", F.lit(".md")).alias("to_id"))
    gone = v.select("id").where(F.regexp_extract("id", r"(\d+)", 1).cast("long") % 10 == 0)
    stay = ends.join(gone.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    before = stay.join(v.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id")
    after = before.join(gone.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return writers.broken_links(before, after)
