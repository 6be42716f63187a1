"""Queries of facts that hold for a time. Orders are facts: an order replaces an earlier one of its customer."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import light_stem, query_terms
from ..operators import facts as O
from ..operators import inside
from ..operators.batches import remembered_in_order
from ..registry import query
from .views import table, terms_sql

AT = "1996-06-01"

_FACTS = """base AS (
  SELECT o_orderkey AS id, o_orderkey AS ord, o_custkey AS subject, o_orderpriority AS category, o_orderdate AS valid_from,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 90 DAY END AS valid_until FROM orders),
refs AS (SELECT src, dst FROM (SELECT id AS src, lag(id) OVER (PARTITION BY subject ORDER BY ord) AS dst FROM base) WHERE dst IS NOT NULL AND src % 4 = 0
  UNION ALL SELECT src, dst FROM (SELECT id AS src, lead(id) OVER (PARTITION BY subject ORDER BY ord) AS dst FROM base) WHERE dst IS NOT NULL AND src % 5 = 0
  UNION ALL SELECT src, dst FROM (SELECT id AS src, lag(id, 2) OVER (PARTITION BY subject ORDER BY ord) AS dst FROM base) WHERE dst IS NOT NULL AND src % 6 = 0),
repl AS (SELECT dst AS id, first(src ORDER BY src) AS replaced_by, first(valid_from ORDER BY src) AS replaced_at FROM refs JOIN base ON base.id = src WHERE dst < src GROUP BY dst),
facts AS (SELECT base.*, replaced_by, replaced_at FROM base LEFT JOIN repl ON repl.id = base.id),
st AS (SELECT *, CASE WHEN valid_from > TIMESTAMP '1996-06-01' THEN 'upcoming'
    WHEN coalesce(valid_until <= TIMESTAMP '1996-06-01', false) AND (replaced_at IS NULL OR valid_until <= replaced_at) THEN 'expired'
    WHEN coalesce(replaced_at <= TIMESTAMP '1996-06-01', false) THEN 'replaced'
    WHEN coalesce(valid_until <= TIMESTAMP '1996-06-01', false) THEN 'expired' ELSE 'current' END AS status FROM facts)"""


def base(spark, d):
    o = table(spark, d, "orders")
    until = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("category"),
        F.col("o_orderdate").alias("valid_from"), until.alias("valid_until"),
    )


def refs(spark, d):
    """(src, dst): every fourth fact names the one before of its subject, every fifth a later one, every sixth the second before."""
    w = W.partitionBy("subject").orderBy("ord")
    b = base(spark, d).select("id", F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("n"), F.lag("id", 2).over(w).alias("q"))
    named = F.array(*(F.when(F.col("id") % m == 0, F.col(c)) for m, c in ((4, "p"), (5, "n"), (6, "q"))))
    return b.select(F.col("id").alias("src"), F.explode(F.filter(named, lambda x: x.isNotNull())).alias("dst"))


def facts(spark, d):
    b = base(spark, d)
    return b.join(O.replacements(b, refs(spark, d)), "id", "left")


def at():
    return F.lit(AT).cast("timestamp_ntz")


@query(f"WITH {_FACTS} SELECT * FROM repl")
def facts_replacements(spark, d):
    return O.replacements(base(spark, d), refs(spark, d))


@query(f"WITH {_FACTS} SELECT * FROM facts")
def facts_derive(spark, d):
    return facts(spark, d)


@query(f"WITH {_FACTS} SELECT src, dst, 'names a later fact' AS warning FROM refs WHERE dst >= src UNION ALL SELECT src, dst, 'already replaced' FROM refs JOIN repl ON repl.id = dst WHERE dst < src AND src <> replaced_by")
def facts_warnings(spark, d):
    rows = refs(spark, d)
    first = O.replacements(base(spark, d), rows).select(F.col("id").alias("dst"), "replaced_by")
    late = F.when(F.col("dst") >= F.col("src"), "names a later fact").when(F.col("src") != F.col("replaced_by"), "already replaced")
    return rows.join(first, "dst", "left").select("src", "dst", late.alias("warning")).where("warning is not null")


@query(f"WITH {_FACTS} SELECT id, status FROM st")
def facts_status(spark, d):
    return facts(spark, d).select("id", O.status(at()).alias("status"))


@query(f"WITH {_FACTS} SELECT id, CASE WHEN valid_until IS NULL THEN replaced_at WHEN replaced_at IS NULL THEN valid_until ELSE least(valid_until, replaced_at) END AS ends FROM facts")
def facts_end(spark, d):
    return facts(spark, d).select("id", O.end_of().alias("ends"))


@query(f"WITH {_FACTS} SELECT id, subject FROM facts WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1996-06-01') AND (replaced_at IS NULL OR replaced_at > TIMESTAMP '1996-06-01')")
def facts_true_at(spark, d):
    return O.true_at(facts(spark, d), at()).select("id", "subject")


@query(f"""WITH {_FACTS}, times AS (SELECT DISTINCT date_trunc('quarter', o_orderdate)::TIMESTAMP AS t FROM orders)
SELECT t, count(*) AS n FROM times JOIN facts ON valid_from <= t AND (valid_until IS NULL OR valid_until > t) AND (replaced_at IS NULL OR replaced_at > t) GROUP BY t""")
def facts_true_at_times(spark, d):
    """As-of counts for many times at once: every start adds one and every end takes one away, summed in time order,
    so no fact meets every time."""
    f = facts(spark, d).select("valid_from", O.end_of().alias("ends")).where("ends is null or ends > valid_from")
    change = f.select(F.col("valid_from").alias("t"), F.lit(1).alias("x")).union(f.where("ends is not null").select("ends", F.lit(-1)))
    # what changes between two times is one number for each
    first = change.groupBy(F.date_trunc("quarter", "t").cast("timestamp_ntz").alias("q"), (F.col("t") == F.date_trunc("quarter", "t")).alias("sharp")).agg(F.sum("x").alias("x"))
    first = first.select(F.when(F.col("sharp"), F.col("q")).otherwise(F.col("q") + F.expr("INTERVAL 3 MONTHS")).alias("t"), "x")
    times = table(spark, d, "orders").select(F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("t")).distinct()
    steps = first.withColumn("asked", F.lit(False)).union(times.select("t", F.lit(0), F.lit(True))).groupBy("t").agg(F.sum("x").alias("x"), F.max("asked").alias("asked"))
    # as many rows as quarters
    n = F.sum("x").over(W.orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    return steps.withColumn("n", n).where("asked and n > 0").select("t", "n")


@query(f"WITH {_FACTS} SELECT a.id, b.id AS other FROM st a JOIN st b ON a.subject = b.subject AND a.category = b.category AND b.id < a.id AND b.status IN ('current', 'upcoming')")
def facts_same_key(spark, d):
    """Facts whose key an older fact has that is current or still to come: what a new fact would replace by itself."""
    f = facts(spark, d).select("id", "subject", "category", O.status(at()).alias("status"))
    old = f.where("status in ('current', 'upcoming')").select(F.col("id").alias("other"), "subject", "category")
    return f.join(old, ["subject", "category"]).where("other < id").select("id", "other")


@query(f"""WITH {_FACTS} SELECT id, CASE status WHEN 'current' THEN NULL WHEN 'upcoming' THEN 'upcoming, from ' || strftime(valid_from, '%Y-%m-%d')
  WHEN 'replaced' THEN 'replaced by ' || replaced_by ELSE 'expired ' || strftime(valid_until, '%Y-%m-%d') END AS flag FROM st""")
def facts_flag(spark, d):
    f = facts(spark, d).withColumn("status", O.status(at()))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return f.select("id", O.flag(F.col("status"), day("valid_from"), day("valid_until"), F.col("replaced_by")).alias("flag"))


@query(f"WITH {_FACTS} SELECT subject, id, status, row_number() OVER (PARTITION BY subject ORDER BY valid_from DESC, ord DESC) AS no, count(*) OVER (PARTITION BY subject) AS total FROM st")
def facts_history(spark, d):
    f = facts(spark, d).select("subject", "id", "ord", "valid_from", O.status(at()).alias("status"))
    w = W.partitionBy("subject").orderBy(F.desc("valid_from"), F.desc("ord"))
    return f.select("subject", "id", "status", F.row_number().over(w).alias("no"), F.count("*").over(W.partitionBy("subject")).alias("total"))


@query(f"""WITH {_FACTS}, u AS (SELECT subject, id, sum(length(category) + 2) OVER (PARTITION BY subject ORDER BY category, valid_from DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM st WHERE status = 'current')
SELECT subject, id, used::BIGINT AS used FROM u WHERE used <= 40""")
def facts_budget(spark, d):
    f = facts(spark, d).where(O.status(at()) == "current")
    f = f.select("subject", "id", F.col("category").alias("prio"), F.col("valid_from").alias("at"), F.length("category").alias("size"))
    return O.within_budget(f, 40).select("subject", "id", "used")


@query(f"""WITH t AS (SELECT item_id AS query_id, {terms_sql("text")} AS terms FROM benchmark),
f AS (SELECT doc_id AS id, lower(text) AS body FROM documents WHERE text IS NOT NULL),
h AS (SELECT query_id, id, len(terms) AS n, len(list_filter(terms, lambda x: contains(body, x))) AS hits FROM t, f WHERE len(terms) > 0)
SELECT query_id, id, hits FROM h WHERE hits >= greatest(1, ceil(n / 2.0))""")
def facts_query(spark, d):
    """Texts that hold at least half of a question's terms, hits counted."""
    t = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), query_terms(F.col("text")).alias("terms"))
    return inside.holding(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), t, 0.5)


_PARTS = """terms AS (
  SELECT p_partkey AS id, list_distinct(list_transform(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' '), lambda t: CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN left(t, -3)
    WHEN t LIKE '%ed' AND length(t) > 4 THEN left(t, -2) WHEN t LIKE '%es' AND length(t) > 4 THEN left(t, -2) WHEN t LIKE '%s' AND length(t) > 3 THEN left(t, -1) ELSE t END)) AS terms,
    p_brand || p_size AS block FROM part),
sim AS (SELECT x.id, y.id AS old, round(len(list_intersect(x.terms, y.terms)) / len(list_distinct(x.terms || y.terms)), 9) AS j,
  round(len(list_intersect(x.terms, y.terms)) / least(len(x.terms), len(y.terms)), 9) AS c FROM terms x JOIN terms y ON y.block = x.block AND y.id < x.id)"""


def part_terms(spark, d):
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), " ")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.array_distinct(F.transform(words, light_stem)).alias("terms"), F.concat("p_brand", F.col("p_size").cast("string")).alias("block")
    )


@query(f"WITH {_PARTS} SELECT id, old, j, c FROM sim WHERE j >= 0.3")
def jaccard_pairs(spark, d):
    """Similar facts of one key."""
    return O.similar_pairs(part_terms(spark, d), 0.3)


@query(f"""WITH {_PARTS}, best AS (SELECT id, first(old ORDER BY greatest(j, round(0.9 * c, 9)) DESC, old) AS best, first(j ORDER BY greatest(j, round(0.9 * c, 9)) DESC, old) AS j, first(c ORDER BY greatest(j, round(0.9 * c, 9)) DESC, old) AS c FROM sim WHERE j > 0 GROUP BY id)
SELECT t.id, best, CASE WHEN j >= 0.6 OR c >= 0.85 THEN 'duplicate' WHEN j >= 0.3 THEN 'update' ELSE 'new' END AS verdict FROM terms t LEFT JOIN best ON best.id = t.id""")
def dup_verdict(spark, d):
    """Each fact against the older ones of its key: duplicate, update or new."""
    t = part_terms(spark, d)
    own = F.transform("terms", lambda x: F.concat(F.col("block"), F.lit("\t"), x))
    keyed = t.select("id", own.alias("terms"))
    return O.verdicts(keyed, keyed)


def part_batch(spark, d):
    """(new, current): parts as facts. A quarter is current; the others are told in the order of their keys, some with a
    key of their own kind, some naming an earlier part, some forced."""
    t = part_terms(spark, d)
    k, own = F.col("id"), F.transform("terms", lambda x: F.concat(F.col("block"), F.lit("\t"), x))
    name = lambda c: c.cast("string")
    none = F.array().cast("array<string>")
    rows = t.select(
        k.alias("ord"), name(k).alias("id"), F.element_at("terms", -1).alias("category"), F.when(k % 5 == 0, F.lit("one key")).alias("key"), own.alias("terms"),
        F.when(k % 11 == 0, F.array(name(k - 7))).otherwise(none).alias("named"), (k % 13 == 0).alias("force"),
    )
    return rows.where(k % 4 != 0), rows.where(k % 4 == 0).select((F.col("ord") - (1 << 40)).alias("ord"), "id", "category", "key", "terms")


@query()
def remember_in_order(spark, d):
    """What becomes of parts told one after another: refused, duplicate, held or stored. A fifth of them has one key."""
    got = remembered_in_order(*part_batch(spark, d))
    return got.select(F.col("id").cast("long").alias("id"), "verdict", F.col("match").cast("long").alias("match"), F.array_join("replaces", "|").alias("replaces"))
