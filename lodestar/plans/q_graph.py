"""Queries of the link graph. Suppliers are notes, line items the links between them."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import TOKEN
from ..operators import graph as G
from ..operators import resolve as R
from ..registry import query
from .views import NOTES, POSTINGS, notes, postings, table

_EDGES = """n AS (SELECT count(*) AS n FROM supplier), edges AS (
  SELECT l_suppkey AS a, l_partkey % n AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS pos,
    CASE WHEN l_returnflag = 'R' THEN 'sentence' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'table' WHEN l_linenumber % 2 = 0 THEN 'fm' ELSE 'list_bare' END AS kind,
    CASE WHEN l_returnflag <> 'R' AND NOT (l_returnflag = 'A' AND l_linestatus = 'F') AND l_linenumber % 2 = 0 THEN CASE WHEN l_linenumber = 2 THEN 'related' ELSE 'mentions' END END AS fm_key
  FROM lineitem, n),
w AS (SELECT *, CASE kind WHEN 'sentence' THEN 1.0 WHEN 'table' THEN 0.5 WHEN 'list_bare' THEN 0.3 WHEN 'fm' THEN CASE fm_key WHEN 'related' THEN 0.3 ELSE 0.2 END ELSE 0 END::DOUBLE AS weight FROM edges)"""
_PAIRS = f"""{_EDGES}, pairs AS (SELECT a, b, max(weight) AS base, first(kind ORDER BY -weight, pos) AS kind, count(*) FILTER (kind NOT IN ('fm', 'trailer')) AS bodies, count(*) AS n FROM w WHERE a <> b GROUP BY a, b),
deg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT b AS id, 1 AS i, 0 AS o FROM pairs WHERE base >= 0.15 UNION ALL SELECT a, 0, 1 FROM pairs WHERE base >= 0.15) GROUP BY id)"""
_STRONG = f"""{_PAIRS}, own AS (
  SELECT p.*, base * CASE WHEN p.bodies > 0 THEN 1 + 0.25 * (least(p.bodies, 3) - 1) ELSE 1 END
    * CASE WHEN p.bodies > 0 AND base >= 0.3 AND EXISTS (SELECT 1 FROM pairs q WHERE q.a = p.b AND q.b = p.a AND q.bodies > 0) THEN 1.2 ELSE 1 END AS own FROM pairs p),
strong AS (SELECT own.*, own * log2(3) / log2(2 + greatest(1, coalesce(x.in_degree, 1))) AS out_strength, 0.8 * own * log2(3) / log2(2 + greatest(1, coalesce(y.out_degree, 1))) AS in_strength
  FROM own LEFT JOIN deg x ON x.id = own.b LEFT JOIN deg y ON y.id = own.a)"""
_NB = f"""{_STRONG}, nb0 AS (SELECT a AS id, b AS nb, round(out_strength, 9) AS strength, 'out' AS dir FROM strong UNION ALL SELECT b, a, round(in_strength, 9), 'in' FROM strong),
nb AS (SELECT id, nb, strength, dir, row_number() OVER (PARTITION BY id ORDER BY strength DESC, nb) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id, nb ORDER BY strength DESC, dir DESC) AS k FROM nb0) WHERE k = 1)"""


def edges(spark, d):
    # one number
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    l = table(spark, d, "lineitem").crossJoin(F.broadcast(n))
    table_row = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    fm = (F.col("l_returnflag") != "R") & ~table_row & (F.col("l_linenumber") % 2 == 0)
    return l.select(
        F.col("l_suppkey").alias("a"), (F.col("l_partkey") % F.col("n")).alias("b"),
        F.struct("l_orderkey", "l_linenumber").alias("pos"),  # compared, never counted: no window over all links of a note
        F.when(F.col("l_returnflag") == "R", "sentence").when(table_row, "table").when(F.col("l_linenumber") % 2 == 0, "fm").otherwise("list_bare").alias("kind"),
        F.when(fm, F.when(F.col("l_linenumber") == 2, "related").otherwise("mentions")).alias("fm_key"),
    )


def parts_of(spark, d):
    return G.parts_of(spark, table(spark, d, "lineitem").count())


def pairs_of(spark, d):
    return G.pairs(G.weighted(edges(spark, d)), parts_of(spark, d))


def strong(spark, d):
    return G.strengths(pairs_of(spark, d), parts_of(spark, d))


def near(spark, d):
    return G.neighbours(strong(spark, d))


@query(f"WITH {_EDGES} SELECT kind, fm_key, weight, count(*) AS n FROM w GROUP BY ALL")
def edge_weights(spark, d):
    return G.weighted(edges(spark, d)).groupBy("kind", "fm_key", "weight").agg(F.count("*").alias("n"))


@query(f"WITH {_EDGES} SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def edge_kind_counts(spark, d):
    return edges(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def pair_edges(spark, d):
    return pairs_of(spark, d)


@query(f"WITH {_PAIRS} SELECT * FROM deg")
def degrees(spark, d):
    return G.degrees(pairs_of(spark, d))


@query(f"WITH {_STRONG} SELECT a, b, round(out_strength, 6) AS out_strength, round(in_strength, 6) AS in_strength FROM strong")
def graph_strength(spark, d):
    return strong(spark, d).select("a", "b", F.round("out_strength", 6).alias("out_strength"), F.round("in_strength", 6).alias("in_strength"))


@query(f"WITH {_NB} SELECT id, nb, round(strength, 6) AS strength, dir, rank FROM nb WHERE rank <= 5")
def neighbours_top(spark, d):
    return near(spark, d).where("rank <= 5").select("id", "nb", F.round("strength", 6).alias("strength"), "dir", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_EDGES} SELECT b AS id, a AS linker, count(*) AS n FROM edges WHERE a <> b AND (kind <> 'fm' OR fm_key = 'related') GROUP BY a, b")
def backlinks(spark, d):
    rows = edges(spark, d).where("a <> b and (kind <> 'fm' or fm_key = 'related')")
    return rows.groupBy(F.col("b").alias("id"), F.col("a").alias("linker")).agg(F.count("*").alias("n"))


@query(f"WITH {_EDGES} SELECT DISTINCT e.a, e.b, s_name AS title FROM edges e LEFT JOIN supplier ON s_suppkey = e.b AND e.b % 3 <> 0")
def outgoing_links(spark, d):
    names = table(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("b"), F.col("s_name").alias("title"))
    return edges(spark, d).select("a", "b").distinct().join(names, "b", "left").select("a", "b", "title")


@query(r"""SELECT target, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS target FROM pages) WHERE target NOT IN (SELECT lower(url) FROM pages) GROUP BY target ORDER BY n DESC, target LIMIT 15""")
def unresolved_top(spark, d):
    pages = table(spark, d, "pages")
    targets = pages.select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    missing = targets.join(pages.select(F.lower("url").alias("target")), "target", "left_anti")
    return missing.groupBy("target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(15)


@query(f"WITH {_PAIRS} SELECT count(*) AS pairs, count(*) FILTER (kind IN ('sentence', 'list_explained', 'embed')) AS content_pairs, count(DISTINCT a) FILTER (kind IN ('sentence', 'list_explained', 'embed')) AS content_sources, sum(n)::BIGINT AS occurrences FROM pairs")
def graph_stats(spark, d):
    content = F.col("kind").isin("sentence", "list_explained", "embed")
    return pairs_of(spark, d).agg(
        F.count("*").alias("pairs"), F.count_if(content).alias("content_pairs"), F.count_distinct(F.when(content, F.col("a"))).alias("content_sources"), F.sum("n").alias("occurrences")
    )


@query(f"WITH {_STRONG} SELECT least(a, b) AS x, greatest(a, b) AS y, round(max(greatest(out_strength, in_strength)), 3) AS strength FROM strong GROUP BY 1, 2")
def graph_export_links(spark, d):
    rows = strong(spark, d)
    return rows.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.round(F.max(F.greatest("out_strength", "in_strength")), 3).alias("strength"))


@query(f"""WITH {_STRONG}, bond AS (SELECT x, y, max(0.35 + 0.65 * least(1.0, greatest(out_strength, in_strength) / 0.6)) AS bond FROM (SELECT a AS x, b AS y, out_strength, in_strength FROM strong UNION ALL SELECT b, a, out_strength, in_strength FROM strong) GROUP BY x, y),
r1 AS (SELECT y AS id, max(round(bond * 0.95, 9)) AS light FROM bond WHERE x = 1 AND y <> 1 GROUP BY y),
r2 AS (SELECT y AS id, max(round(light * bond * 0.74, 9)) AS light FROM r1 JOIN bond ON x = id WHERE y <> 1 AND y NOT IN (SELECT id FROM r1) GROUP BY y),
r3 AS (SELECT y AS id, max(round(light * bond * 0.79, 9)) AS light FROM r2 JOIN bond ON x = id WHERE y <> 1 AND y NOT IN (SELECT id FROM r1) AND y NOT IN (SELECT id FROM r2) GROUP BY y)
SELECT 1 AS id, 0 AS hop, 1.0::DOUBLE AS light UNION ALL SELECT id, 1, round(light, 6) FROM r1 UNION ALL SELECT id, 2, round(light, 6) FROM r2 UNION ALL SELECT id, 3, round(light, 6) FROM r3""")
def graph_glow(spark, d):
    start = spark.createDataFrame([(1,)], "id long")
    return G.glow(strong(spark, d), start, parts=parts_of(spark, d)).select("id", "hop", F.round("light", 6).alias("light"))


_SEEDS = "seeds AS (SELECT c_custkey % 20 AS query_id, c_custkey % n AS note, max(c_acctbal) AS score, row_number() OVER (PARTITION BY c_custkey % 20 ORDER BY max(c_acctbal) DESC, c_custkey % n) AS rank FROM customer, n GROUP BY 1, 2)"


def seeds(spark, d):
    n = table(spark, d, "supplier").agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").crossJoin(F.broadcast(n))
    c = c.groupBy((F.col("c_custkey") % 20).alias("query_id"), (F.col("c_custkey") % F.col("n")).alias("note")).agg(F.max("c_acctbal").alias("score"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "note")))


@query(f"WITH {_EDGES}, {_SEEDS} SELECT query_id, note, round(score, 6) AS score, rank FROM seeds WHERE rank <= 5")
def graph_seeds(spark, d):
    return seeds(spark, d).where("rank <= 5").select("query_id", "note", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_PICKS = f"""{_NB}, {_SEEDS}, top AS (SELECT * FROM seeds WHERE rank <= 5),
c AS (SELECT query_id, top.rank AS seed, nb AS note, round(greatest(score, 0) * strength, 6) AS s FROM top JOIN nb ON nb.id = top.note WHERE strength >= 0.2 AND nb NOT IN (SELECT t.note FROM top t WHERE t.query_id = top.query_id)),
c3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seed ORDER BY s DESC, note) AS k FROM c) WHERE k <= 3),
picks AS (SELECT query_id, note, round(max(s) * (1 + 0.5 * (count(*) - 1)), 6) AS fit, min(seed) AS seed FROM c3 GROUP BY query_id, note)"""


def picks(spark, d):
    top = seeds(spark, d).where("rank <= 5")
    nb = near(spark, d).where("strength >= 0.2").select(F.col("id").alias("note"), "nb", "strength")
    c = top.join(nb, "note").select("query_id", F.col("rank").alias("seed"), F.col("nb").alias("note"), F.round(F.greatest("score", F.lit(0.0)) * F.col("strength"), 6).alias("s"))
    c = c.join(top.select("query_id", "note"), ["query_id", "note"], "left_anti")
    c = c.withColumn("k", F.row_number().over(W.partitionBy("query_id", "seed").orderBy(F.desc("s"), "note"))).where("k <= 3")
    return c.groupBy("query_id", "note").agg(F.round(F.max("s") * (1 + 0.5 * (F.count("*") - 1)), 6).alias("fit"), F.min("seed").alias("seed"))


@query(f"WITH {_PICKS} SELECT query_id, note, fit, seed FROM picks")
def graph_picks(spark, d):
    return picks(spark, d).select("query_id", "note", "fit", F.col("seed").cast("long").alias("seed"))


@query(f"WITH {_EDGES}, {_SEEDS} SELECT query_id, note FROM seeds WHERE rank <= 5 UNION SELECT query_id, note FROM seeds WHERE rank <= 10 AND note % 2 = 0")
def graph_protected(spark, d):
    s = seeds(spark, d)
    return s.where("rank <= 5 or (rank <= 10 and note % 2 = 0)").select("query_id", "note").distinct()


@query(f"""WITH {_PICKS}, weak AS (SELECT query_id, note AS out, score AS low, row_number() OVER (PARTITION BY query_id ORDER BY score, rank DESC) AS i FROM seeds WHERE rank > 3 AND note % 4 <> 0),
strong2 AS (SELECT query_id, note AS into_, fit AS high, row_number() OVER (PARTITION BY query_id ORDER BY fit DESC, note) AS i FROM picks),
j AS (SELECT *, min((high > low)::INT) OVER (PARTITION BY query_id ORDER BY i) AS good FROM weak JOIN strong2 USING (query_id, i))
SELECT query_id, out, into_ AS "into" FROM j WHERE good = 1""")
def graph_fair_swap(spark, d):
    s = seeds(spark, d)
    head = s.select("query_id", F.col("note").alias("key"), "rank", F.col("score").alias("fit"))
    return G.fair_swap(head, picks(spark, d).select("query_id", F.col("note").alias("key"), "fit"), head.where("key % 4 = 0").select("query_id", "key"))


@query(f"""WITH {_NB}, {_SEEDS}, kept AS (SELECT query_id, note FROM seeds WHERE rank <= 4), cut AS (SELECT query_id, note, score FROM seeds WHERE rank > 4),
p AS (SELECT cut.query_id, cut.note, cut.score, kept.note AS anchor, strength, row_number() OVER (PARTITION BY cut.query_id, cut.note ORDER BY strength DESC, kept.note) AS k FROM cut JOIN kept ON kept.query_id = cut.query_id JOIN nb ON nb.id = kept.note AND nb.nb = cut.note WHERE strength >= 0.1)
SELECT query_id, note, anchor FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, note) AS r FROM p WHERE k = 1) WHERE r <= 1""")
def graph_partners(spark, d):
    s = seeds(spark, d)
    kept = s.where("rank <= 4").select("query_id", F.col("note").alias("anchor"))
    nb = near(spark, d).where("strength >= 0.1").select(F.col("id").alias("anchor"), F.col("nb").alias("note"), "strength")
    p = s.where("rank > 4").join(kept.join(nb, "anchor"), ["query_id", "note"])
    p = p.withColumn("k", F.row_number().over(W.partitionBy("query_id", "note").orderBy(F.desc("strength"), "anchor"))).where("k = 1")
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "note"))
    return p.withColumn("r", r).where("r <= 1").select("query_id", "note", "anchor")


@query(f"""WITH t AS (SELECT DISTINCT l_orderkey AS note, l_partkey AS topic FROM lineitem)
SELECT a.note AS id, b.note AS nb, count(*) AS n, string_agg(CAST(a.topic AS VARCHAR), '|' ORDER BY a.topic) AS topics FROM t a JOIN t b ON a.topic = b.topic AND a.note <> b.note GROUP BY a.note, b.note""")
def shared_topic_neighbours(spark, d):
    return G.sharing(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("note"), F.col("l_partkey").alias("topic")))


# Notes in folders of their source and language. Every note links to others in ten ways; all notes of a source share an alias.
_FILED = r"""n AS (SELECT count(*) AS n FROM documents), filed AS (
  SELECT doc_id AS k, coalesce(source, 'none') AS src, coalesce(lang, 'none') AS lang, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/Doc ' || doc_id || '.md' AS id,
    coalesce(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+')[1:3], ' '), '') AS title FROM documents),
aimed AS (SELECT f.id AS from_id, f.k, CASE f.k % 10 WHEN 0 THEN t.src || '/' || t.lang || '/Doc ' || t.k WHEN 1 THEN t.lang || '/DOC  ' || t.k WHEN 2 THEN t.src || '/' || t.lang || '/doc-' || t.k WHEN 3 THEN t.lang || '/doc_' || t.k
    WHEN 4 THEN t.title WHEN 5 THEN 'Doc ' || t.k WHEN 6 THEN 'No. ' || t.k WHEN 7 THEN 'Doc__' || t.k WHEN 8 THEN 'No such ' || t.k ELSE t.src END AS target
  FROM filed f, n JOIN filed t ON t.k = (f.k * 7 + 3) % n.n)"""
_FOLD = lambda x: rf"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
_SLUG = lambda x: rf"trim(regexp_replace(lower({x}), '[-_\s]+', ' ', 'g'))"


def filed(spark, d):
    """(id, title, aliases, k, src, lang): documents as notes in folders."""
    src, lang, k = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string")
    title = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), 1, 3), " ")
    return table(spark, d, "documents").select(
        F.concat(src, F.lit("/"), lang, F.lit("/Doc "), k, F.lit(".md")).alias("id"), F.coalesce(title, F.lit("")).alias("title"), F.array(F.concat(F.lit("No. "), k), src).alias("aliases"),
        F.col("doc_id").alias("k"), src.alias("src"), lang.alias("lang"),
    )


def aimed(spark, d):
    """(from_id, k, target): a link of each note, written in one of ten ways."""
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))  # one number
    f, t = filed(spark, d).crossJoin(F.broadcast(n)).withColumn("to", (F.col("k") * 7 + 3) % F.col("n")), filed(spark, d).select(F.col("k").alias("to"), "src", "lang", "title")
    both = f.select(F.col("id").alias("from_id"), "k", "to").join(t, "to")
    of, slash = F.col("to").cast("string"), F.lit("/")
    forms = [
        F.concat("src", slash, "lang", F.lit("/Doc "), of), F.concat("lang", F.lit("/DOC  "), of), F.concat("src", slash, "lang", F.lit("/doc-"), of), F.concat("lang", F.lit("/doc_"), of), F.col("title"),
        F.concat(F.lit("Doc "), of), F.concat(F.lit("No. "), of), F.concat(F.lit("Doc__"), of), F.concat(F.lit("No such "), of), F.col("src"),
    ]
    return both.select("from_id", "k", F.element_at(F.array(*forms), (F.col("k") % 10 + 1).cast("int")).alias("target"))


_RESOLVED = f"""{_FILED}, names AS (
  SELECT id, 0 AS stage, 'plain' AS way, lower(src || '/' || lang || '/doc ' || k) AS name FROM filed UNION ALL SELECT id, 1, 'plain', lower(lang || '/doc ' || k) FROM filed
  UNION ALL SELECT id, 2, 'path', {_SLUG("src")} || '/' || {_SLUG("lang")} || '/doc ' || k FROM filed UNION ALL SELECT id, 3, 'path', {_SLUG("lang")} || '/doc ' || k FROM filed
  UNION ALL SELECT id, 4, 'plain', lower(title) FROM filed UNION ALL SELECT id, 5, 'plain', 'doc ' || k FROM filed UNION ALL SELECT id, 6, 'plain', 'no. ' || k FROM filed UNION ALL SELECT id, 6, 'plain', {_FOLD("src")} FROM filed
  UNION ALL SELECT DISTINCT id, 7, 'slug', s FROM (SELECT id, unnest([{_SLUG("title")}, 'doc ' || k, 'no. ' || k, {_SLUG("src")}]) AS s FROM filed)),
looked AS (SELECT from_id, k, target, unnest([{{'way': 'plain', 'name': {_FOLD("target")}}}, {{'way': 'path', 'name': CASE WHEN contains(target, '/') THEN {_SLUG("target")} END}}, {{'way': 'slug', 'name': {_SLUG("target")}}}]) AS x FROM aimed),
met AS (SELECT from_id, k, target, stage, names.id, regexp_replace(names.id, '/[^/]*$', '') = regexp_replace(from_id, '/[^/]*$', '') AS near FROM looked JOIN names ON names.way = x.way AND names.name = x.name AND x.name <> ''),
first_ AS (SELECT k, min(stage) AS stage FROM met GROUP BY k),
best AS (SELECT k, stage, first(id ORDER BY near DESC, length(id), id) AS to_id, count(DISTINCT id) AS n FROM met SEMI JOIN first_ USING (k, stage) GROUP BY k, stage)"""


@query(f"""WITH {_RESOLVED} SELECT from_id, target, to_id, ['path', 'suffix', 'path slug', 'suffix slug', 'title', 'file', 'alias', 'slug'][stage + 1] AS stage, n FROM aimed LEFT JOIN best USING (k)""")
def resolve_links(spark, d):
    """What each link points at, by which of eight stages, and how many notes share the name there."""
    return R.resolved(aimed(spark, d), filed(spark, d)).select("from_id", "target", "to_id", "stage", "n")


@query(f"""WITH {_RESOLVED} SELECT {_FOLD("target")} AS name, max(n) AS n FROM aimed JOIN best USING (k) WHERE n > 1 GROUP BY 1""")
def ambiguous_links(spark, d):
    """Names of links that several notes have."""
    return R.ambiguous(R.resolved(aimed(spark, d), filed(spark, d)))


@query(f"WITH {NOTES} SELECT lower(title) AS name, count(DISTINCT id) AS n, min(id) AS first FROM notes GROUP BY 1 HAVING count(DISTINCT id) > 1")
def ambiguous_names(spark, d):
    return notes(spark, d).groupBy(F.lower("title").alias("name")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("first")).where("n > 1")


@query(f"WITH {NOTES} SELECT id, unnest(['full', 'suffix', 'base', 'title']) AS kind, unnest([path, substr(path, strpos(path, '/') + 1), split_part(path, '/', -1), lower(title)]) AS name FROM notes")
def name_dictionary(spark, d):
    parts = F.split("path", "/")
    rows = F.array(
        F.struct(F.lit("full").alias("kind"), F.col("path").alias("name")), F.struct(F.lit("suffix").alias("kind"), F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), "/").alias("name")),
        F.struct(F.lit("base").alias("kind"), F.element_at(parts, -1).alias("name")), F.struct(F.lit("title").alias("kind"), F.lower("title").alias("name")),
    )
    return notes(spark, d).select("id", F.inline(rows))


@query(f"WITH {NOTES} SELECT lower(title) AS name, min(id) AS id, any_value(type) IS NOT NULL AS ok FROM notes GROUP BY 1")
def titles_dict(spark, d):
    return notes(spark, d).groupBy(F.lower("title").alias("name")).agg(F.min("id").alias("id"), F.lit(True).alias("ok"))


@query(f"WITH {NOTES}, {POSTINGS} SELECT term, count(DISTINCT key) AS df FROM postings WHERE length(term) >= 5 GROUP BY term HAVING count(DISTINCT key) BETWEEN 2 AND (SELECT count(*) FROM notes) * 0.05")
def rare_words(spark, d):
    """Words of five letters or more in two notes at least and in at most a twentieth of all."""
    most = table(spark, d, "documents").agg((F.count("*") * 0.05).alias("most"))  # one number
    df = postings(spark, d).where("length(term) >= 5").select("term", "key").distinct().groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(most)).where("df between 2 and most").select("term", "df")


@query(r"""WITH RECURSIVE t AS (SELECT vec_id % 40 AS note, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT note, i, avg(x) AS x FROM t GROUP BY note, i), l AS (SELECT note, sqrt(sum(x * x)) AS l FROM m GROUP BY note)
SELECT m.note, i - 1 AS i, round(x / l, 6) AS x FROM m JOIN l USING (note)""")
def mean_vectors(spark, d):
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 40).alias("note"), F.posexplode("embedding").alias("i", "x"))
    m = v.groupBy("note", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = m.groupBy("note").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return m.join(norm, "note").select("note", F.col("i").cast("long").alias("i"), F.round(F.col("x") / F.col("l"), 6).alias("x"))
