"""Queries of retrieval: BM25, dense, fusion, gate, packing. Many questions at once, by query_id."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import title_overlap, tokens
from ..lineage import cut
from ..operators import retrieval as R
from ..registry import query
from .views import NOTES, POSTINGS, QUESTIONS, notes, postings, questions, table

_BM25 = rf"""{POSTINGS}, {QUESTIONS},
dl AS (SELECT key, count(*) AS dl FROM postings GROUP BY key),
whole AS (SELECT count(*) AS n_rows, avg(dl) AS avgdl FROM dl),
asked AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM questions),
tf AS (SELECT term, key, count(*) AS tf FROM postings WHERE term IN (SELECT term FROM asked) GROUP BY term, key),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT tf.term, tf.key, greatest(ln((n_rows - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s
      FROM tf JOIN df ON df.term = tf.term JOIN dl ON dl.key = tf.key, whole),
scored AS (SELECT query_id, key, sum(s) AS score, count(*) AS matched FROM asked JOIN s ON s.term = asked.term GROUP BY query_id, key),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, key) AS rank FROM scored) WHERE rank <= 40)"""

_DENSE = r"""den AS (
  SELECT * FROM (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, key) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id AS key, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score
    FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)) WHERE rank <= 40)"""


TEXT = {"text": 1.0}


def words(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), tokens(F.col("text")).alias("text"))


def lexical(spark, d, most=40, hidden=None):
    """Keys of hidden count in BM25's statistics only."""
    got = R.bm25(words(spark, d), questions(spark, d), TEXT)
    return R.ranked(got if hidden is None else got.join(hidden, "key", "left_anti"), most=most)


def dense_list(spark, d, most=40, hidden=None):
    """Every vector whose id is divisible by twenty is a question."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    q = v.where("key % 20 = 0").select(F.col("key").alias("query_id"), F.col("v").alias("q"))
    got = R.dense(v if hidden is None else v.join(hidden, "key", "left_anti"), q, most)
    return R.ranked(got, most=most)


@query(f"WITH {_BM25} SELECT query_id, key, round(score, 6) AS score, rank FROM lex WHERE rank <= 20")
def bm25_basic(spark, d):
    return lexical(spark, d, 20).select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FIELDS = r"""fp AS (
  SELECT key, unnest(t) AS term, field FROM (
    SELECT doc_id AS key, 'text' AS field, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents
    UNION ALL SELECT doc_id, 'title', regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:3] FROM documents
    UNION ALL SELECT doc_id, 'project', [source] FROM documents))"""


@query(rf"""WITH {QUESTIONS}, {_FIELDS},
dl AS (SELECT key, count(*) AS dl FROM fp GROUP BY key), whole AS (SELECT count(*) AS n_rows, avg(dl) AS avgdl FROM dl),
asked AS (SELECT DISTINCT query_id, unnest(terms) AS term FROM questions),
tf AS (SELECT term, key, sum(CASE field WHEN 'title' THEN 4 WHEN 'project' THEN 1.5 ELSE 1 END)::DOUBLE AS tf FROM fp WHERE term IN (SELECT term FROM asked) GROUP BY term, key),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT tf.term, tf.key, greatest(ln((n_rows - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s
      FROM tf JOIN df ON df.term = tf.term JOIN dl ON dl.key = tf.key, whole),
scored AS (SELECT query_id, key, sum(s) AS score FROM asked JOIN s ON s.term = asked.term GROUP BY query_id, key)
SELECT query_id, key, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, key) AS rank FROM scored) WHERE rank <= 40""")
def bm25_fields(spark, d):
    t = tokens(F.col("text"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("key"), t.alias("text"), F.slice(t, 1, 3).alias("title"), F.array("source").alias("project"))
    got = R.bm25(rows, questions(spark, d), {"title": 4.0, "text": 1.0, "project": 1.5})
    return R.ranked(got, most=40).select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_BM25} SELECT query_id, key, matched FROM scored JOIN (SELECT query_id, len(terms) AS n FROM questions) USING (query_id) WHERE matched = n")
def fts_and(spark, d):
    q = questions(spark, d)
    got = R.bm25(words(spark, d), q, TEXT).join(q.select("query_id", F.size("terms").alias("n")), "query_id")
    return got.where("matched = n").select("query_id", "key", "matched")


@query(f"WITH {_BM25} SELECT query_id, count(*) AS n, max(matched) AS most FROM scored GROUP BY query_id")
def fts_or(spark, d):
    return R.bm25(words(spark, d), questions(spark, d), TEXT).groupBy("query_id").agg(F.count("*").alias("n"), F.max("matched").alias("most"))


@query(rf"""WITH {POSTINGS}, {QUESTIONS}, asked AS (SELECT query_id, left(t, 4) AS prefix FROM (SELECT query_id, unnest(terms[1:2]) AS t FROM questions) WHERE length(t) >= 4 GROUP BY ALL),
v AS (SELECT DISTINCT term, key FROM postings WHERE length(term) >= 4)
SELECT query_id, key, count(DISTINCT prefix) AS n FROM asked JOIN v ON left(v.term, 4) = prefix GROUP BY query_id, key HAVING count(DISTINCT prefix) = 2""")
def fts_and_prefix(spark, d):
    asked = questions(spark, d).select("query_id", F.explode(F.slice("terms", 1, 2)).alias("t")).where("length(t) >= 4").select("query_id", F.left("t", F.lit(4)).alias("prefix")).distinct()
    v = postings(spark, d).where("length(term) >= 4").select(F.left("term", F.lit(4)).alias("prefix"), "key").distinct()
    return asked.join(v, "prefix").groupBy("query_id", "key").agg(F.count("*").alias("n")).where("n = 2")


# Each question asks for its words in phrases of one to six, joined by hyphens.
_PHRASED = r"""toks AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
chopped AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark),
phrases AS (SELECT DISTINCT query_id, t[i:i + least(5, i % 6)] AS parts FROM (SELECT query_id, t, unnest(range(1, len(t) + 1, 4)) AS i FROM chopped)),
p AS (SELECT DISTINCT parts FROM phrases), places AS (SELECT key, t, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS pos FROM toks),
tf AS (SELECT parts, key, count(*) AS tf FROM p JOIN places ON word = parts[1] WHERE t[pos:pos + len(parts) - 1] = parts GROUP BY parts, key),
df AS (SELECT parts, count(*) AS df FROM tf GROUP BY parts), whole AS (SELECT count(*) AS n_rows, avg(len(t)) AS avgdl FROM toks WHERE len(t) > 0),
s AS (SELECT tf.parts, tf.key, greatest(ln((n_rows - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avgdl)) AS s
  FROM tf JOIN df ON df.parts = tf.parts JOIN toks ON toks.key = tf.key, whole)"""


def phrased(spark, d):
    words = tokens(F.col("text"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: (i % 4 == 1) & (i <= F.size(words)))
    chop = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.least(F.lit(5), i % 6) + 1), "-"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(chop).alias("terms"))


@query(f"WITH {_PHRASED} SELECT query_id, key, round(sum(s), 6) AS score, count(*) AS matched FROM phrases JOIN s ON s.parts = phrases.parts GROUP BY query_id, key")
def phrase_search(spark, d):
    """Questions of phrases of one to six words against all texts, a phrase as one term with its own frequencies."""
    got = R.bm25(words(spark, d), phrased(spark, d), TEXT)
    return got.select("query_id", "key", F.round("score", 6).alias("score"), "matched")


@query(f"WITH {_PHRASED} SELECT query_id, key, count(*) AS n, sum(tf)::BIGINT AS times FROM phrases JOIN tf ON tf.parts = phrases.parts WHERE len(phrases.parts) > 1 GROUP BY query_id, key")
def phrase_match(spark, d):
    """How many of a question's phrases of two to six words a text has, and how often."""
    asked = phrased(spark, d).select("query_id", F.explode("terms").alias("term")).withColumn("parts", tokens(F.col("term"))).where(F.size("parts") > 1)
    got = R.phrase_hits(words(spark, d), asked.select("term", "parts").distinct(), TEXT)
    return asked.join(got, "term").groupBy("query_id", "key").agg(F.count("*").alias("n"), F.sum("tf").cast("long").alias("times"))


@query(f"WITH {_BM25} SELECT query_id, key, strict, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strict DESC, round(score, 6) DESC, key) AS rank FROM (SELECT *, matched = n AS strict, count(*) FILTER (matched = n) OVER (PARTITION BY query_id) AS k FROM scored JOIN (SELECT query_id, len(terms) AS n FROM questions) USING (query_id)) WHERE strict OR (k < 5 AND n > 1)) WHERE rank <= 30")
def strict_then_loose(spark, d):
    q = questions(spark, d)
    got = R.strict_then_loose(R.bm25(words(spark, d), q, TEXT), q.select("query_id", F.size("terms").alias("n_terms")), 5, 30)
    return got.select("query_id", "key", "strict", F.col("rank").cast("long").alias("rank"))


@query(rf"""WITH {_BM25}, {NOTES}, r AS (
  SELECT lex.query_id, key, 1.0 / (60 + rank - 1) + 0.02 * len(list_filter(terms, lambda t: contains(lower(title), CASE WHEN length(t) > 4 THEN left(t, -1) ELSE t END))) / len(terms) AS score
  FROM lex JOIN questions USING (query_id) JOIN notes ON id = key)
SELECT query_id, key, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, key) AS rank FROM r) WHERE rank <= 10""")
def search_notes(spark, d):
    rows = lexical(spark, d).join(questions(spark, d), "query_id").join(notes(spark, d).select(F.col("id").alias("key"), "title"), "key")
    score = 1.0 / (60 + F.col("rank") - 1) + 0.02 * title_overlap(F.col("title"), F.col("terms"))
    rows = R.ranked(rows.select("query_id", "key", score.alias("score")), most=10)
    return rows.select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_DENSE} SELECT query_id, key, round(score, 6) AS score, rank FROM den")
def dense_topk(spark, d):
    return dense_list(spark, d).select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_DENSE} SELECT query_id, key, rank, label FROM den JOIN (SELECT vec_id AS key, label FROM embeddings) USING (key) WHERE label % 2 = 0")
def dense_topk_filtered(spark, d):
    """Filters other than access come after the cut of forty."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label").where("label % 2 = 0")
    return dense_list(spark, d).join(labels, "key").select("query_id", "key", F.col("rank").cast("long").alias("rank"), "label")


# Keys of the lexical list (documents) and of the dense one (vectors) are taken as one set of sections.
_RRF = rf"""{_BM25}, {_DENSE}, dates AS (SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY key) AS rank FROM lex WHERE key % 7 = 0),
lists AS (SELECT query_id, key, rank AS r, 0 AS no FROM lex UNION ALL SELECT query_id, key, rank, 1 FROM den UNION ALL SELECT query_id, key, rank, 2 FROM dates),
f0 AS (SELECT query_id, key, sum(1.0 / (60 + r)) AS score, min(struct_pack(no := no, r := r)) AS first, list_sort(list(DISTINCT no)) AS lists FROM lists GROUP BY query_id, key),
fused AS (SELECT query_id, key, score, lists, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first.no, first.r) AS rank FROM f0)"""


def three_lists(spark, d, hidden=None):
    lex, den = cut(lexical(spark, d, hidden=hidden)), cut(dense_list(spark, d, hidden=hidden))  # each is read several times
    dates = lex.where("key % 7 = 0").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("key")))
    return [lex, den, dates]


@query(f"WITH {_RRF} SELECT query_id, key, round(score, 9) AS score, rank, list_transform(lists, lambda x: CAST(x AS INTEGER)) AS lists FROM fused")
def rrf_fuse(spark, d):
    return R.fuse(three_lists(spark, d)).select("query_id", "key", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"), "lists")


@query(f"WITH {_RRF} SELECT query_id, key, rank, 'lexical' AS coverage FROM fused WHERE rank <= 8")
def rank_lexical(spark, d):
    """What is returned while no model is there."""
    return R.fuse(three_lists(spark, d)).where("rank <= 8").select("query_id", "key", F.col("rank").cast("long").alias("rank"), F.lit("lexical").alias("coverage"))


_SHORT = f"""{_RRF}, short AS (SELECT fused.* FROM fused LEFT JOIN (SELECT DISTINCT query_id, key, 1 AS one FROM lists WHERE r = 1) USING (query_id, key) WHERE rank <= 16 OR one = 1),
prob AS (SELECT *, ((key * 7919 + query_id * 104729) % 1000) / 1000.0 * CASE WHEN query_id % 5 = 0 THEN 0.04 ELSE 1 END AS prob FROM short),
final AS (SELECT *, 0.8 * prob + 0.2 * score / max(score) OVER (PARTITION BY query_id) AS final FROM prob)"""


def shortlisted(spark, d, hidden=None):
    lists = three_lists(spark, d, hidden)
    return R.shortlist(R.fuse(lists), lists)


def scored(spark, d, hidden=None):
    """The shortlist with the probabilities of a deterministic stand-in scorer."""
    p = ((F.col("key") * 7919 + F.col("query_id") * 104729) % 1000) / 1000.0 * F.when(F.col("query_id") % 5 == 0, 0.04).otherwise(1.0)
    return shortlisted(spark, d, hidden).withColumn("prob", p)


@query(f"WITH {_SHORT} SELECT query_id, key, rank FROM short")
def shortlist(spark, d):
    return shortlisted(spark, d).select("query_id", "key", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_SHORT} SELECT query_id, key, round(prob, 6) AS prob FROM prob")
def rerank_standin(spark, d):
    return scored(spark, d).select("query_id", "key", F.round("prob", 6).alias("prob"))


@query(f"WITH {_SHORT} SELECT query_id, key, round(final, 6) AS final FROM final")
def blend_score(spark, d):
    return R.blended(scored(spark, d)).select("query_id", "key", F.round("final", 6).alias("final"))


@query(f"WITH {_SHORT} SELECT query_id, round(max(prob), 6) AS top, CASE WHEN max(prob) < 0.05 THEN 'none' WHEN max(prob) >= 0.3 THEN 'good' ELSE 'thin' END AS coverage FROM prob GROUP BY query_id")
def coverage_gate(spark, d):
    return R.gated(scored(spark, d)).select("query_id", F.round("top", 6).alias("top"), "coverage")


_TRIM = f"""{_SHORT}, walk AS (SELECT *, row_number() OVER w AS pos, greatest(0.02, 0.3 * max(final) OVER (PARTITION BY query_id)) AS bar FROM final WINDOW w AS (PARTITION BY query_id ORDER BY round(final, 6) DESC, key)),
low AS (SELECT *, final < bar AND pos > 5 AS low FROM walk),
trim AS (SELECT *, CASE WHEN coalesce(max(low::INT) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'stop' WHEN low THEN 'bar' WHEN pos > 8 THEN 'limit' ELSE 'kept' END AS cut FROM low)"""


@query(f"WITH {_TRIM} SELECT query_id, key, pos, cut FROM trim")
def trim_cuts(spark, d):
    return R.trimmed(R.blended(scored(spark, d)), 8).select("query_id", "key", F.col("pos").cast("long").alias("pos"), "cut")


_HYBRID = f"{_TRIM}, hybrid AS (SELECT trim.query_id, key, final, pos FROM trim JOIN (SELECT query_id FROM prob GROUP BY query_id HAVING max(prob) >= 0.05) USING (query_id) WHERE cut = 'kept')"


def hybrid(spark, d, hidden=None):
    rows = scored(spark, d, hidden)
    open_ = R.gated(rows).where("coverage <> 'none'").select("query_id")
    return R.trimmed(R.blended(rows), 8).where("cut = 'kept'").join(open_, "query_id", "left_semi")


@query(f"WITH {_HYBRID} SELECT query_id, key, round(final, 6) AS final, pos FROM hybrid")
def hybrid_rank(spark, d):
    return hybrid(spark, d).select("query_id", "key", F.round("final", 6).alias("final"), F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_HYBRID} SELECT query_id, note, min(pos) AS pos FROM (SELECT query_id, key % 50 AS note, pos FROM hybrid) GROUP BY query_id, note")
def search_rollup(spark, d):
    """The best section of each note; sections of one note are keys alike modulo 50."""
    return hybrid(spark, d).groupBy("query_id", (F.col("key") % 50).alias("note")).agg(F.min("pos").cast("long").alias("pos"))


# The access rule of the SQL: hidden keys leave each list before its first cut.
_OPEN = "(SELECT doc_id FROM labels WHERE toxic = 1)"
_READABLE = _HYBRID.replace("AS rank FROM scored)", f"AS rank FROM scored WHERE key NOT IN {_OPEN})").replace("q.vec_id % 20 = 0)", f"q.vec_id % 20 = 0 AND v.vec_id NOT IN {_OPEN})")


@query(f"WITH {_READABLE} SELECT query_id, key, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM hybrid")
def search_hybrid(spark, d):
    """Private notes leave each list before its first cut, so they crowd out no others."""
    private = notes(spark, d).where("visibility = 'private'").select(F.col("id").alias("key"))
    rows = hybrid(spark, d, private)
    return rows.select("query_id", "key", F.row_number().over(W.partitionBy("query_id").orderBy("pos")).cast("long").alias("rank"))


@query(f"""WITH RECURSIVE {_BM25}, c AS (SELECT query_id, rank, key % 10 AS note, least(3500, n_chars) AS size FROM lex JOIN documents ON doc_id = key),
walk AS (
  SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS used, []::BIGINT[] AS notes, false AS kept FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL
  SELECT c.query_id, c.rank, CASE WHEN ok THEN used + size ELSE used END, CASE WHEN ok THEN list_append(notes, note) ELSE notes END, ok
  FROM (SELECT c.*, w.used, w.notes, w.used + c.size <= 18000 AND len(list_filter(w.notes, lambda x: x = c.note)) < 3 AND len(w.notes) < 10 AS ok FROM walk w JOIN c ON c.query_id = w.query_id AND c.rank = w.rank + 1) c)
SELECT walk.query_id, walk.rank, c.note, c.size FROM walk JOIN c ON c.query_id = walk.query_id AND c.rank = walk.rank WHERE kept""")
def pack_skip(spark, d):
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.least(F.lit(3500), "n_chars").alias("size"))
    rows = lexical(spark, d).join(sizes, "key").select("query_id", (F.col("key") % 10).alias("note"), "rank", "size")
    got = R.packed(rows, 18000, 3, 10)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "note", "size")


@query(f"WITH {_BM25}, c AS (SELECT query_id, key, rank, sum(least(3500, n_chars) + 2) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM lex JOIN documents ON doc_id = key) SELECT query_id, key, rank, CAST(used AS BIGINT) AS used FROM c WHERE used <= 12000")
def pack_prefix(spark, d):
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.least(F.lit(3500), "n_chars").alias("size"))
    used = F.sum(F.col("size") + 2).over(W.partitionBy("query_id").orderBy("rank")).cast("long")
    return lexical(spark, d).join(sizes, "key").withColumn("used", used).where("used <= 12000").select("query_id", "key", F.col("rank").cast("long").alias("rank"), "used")


@query(f"WITH {_BM25} SELECT key, left(text, 220) AS snippet FROM (SELECT DISTINCT key FROM lex) JOIN documents ON doc_id = key")
def snippet_prefix(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.substring("text", 1, 220).alias("snippet"))
    return docs.join(lexical(spark, d).select("key").distinct(), "key", "left_semi")


@query(f"""WITH {_RRF}, c AS (SELECT a.query_id, coalesce(f.rank <= 3, false) AS early FROM lex a JOIN den b USING (query_id) LEFT JOIN fused f ON f.query_id = a.query_id AND f.key = a.key AND a.key = b.key WHERE a.rank = 1 AND b.rank = 1)
SELECT query_id, early, CASE WHEN early THEN 3 ELSE 16 END AS to_score FROM c""")
def early_exit(spark, d):
    """Where the lexical and the dense list agree on the first and fusion has it in its first three, three candidates
    are scored, not sixteen."""
    lists = three_lists(spark, d)
    return R.early_exit(R.fuse(lists), lists[0], lists[1])
