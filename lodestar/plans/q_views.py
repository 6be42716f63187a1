"""Queries of lists, filters, access rules, evaluation and change feeds."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.policy import readable, redacted, secret_kinds
from ..operators import changes as C
from ..registry import query
from .views import NOTES, notes, table

STRUCTURAL = ("hub", "concept", "moc", "meta", "guide")


@query(f"WITH {NOTES} SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM orders) AS facts")
def counts(spark, d):
    """One number a table, from the files' footers where they tell."""
    one = lambda name, t: table(spark, d, t).agg(F.count("*").alias(name))
    return one("notes", "documents").crossJoin(one("vectors", "embeddings")).crossJoin(one("facts", "orders"))


@query(f"WITH {NOTES} SELECT DISTINCT project FROM notes WHERE project IS NOT NULL")
def distinct_projects(spark, d):
    return notes(spark, d).where("project is not null").select("project").distinct()


@query(f"WITH {NOTES} SELECT id, title FROM notes WHERE lower(project) = lower((SELECT min(project) FROM notes)) AND type = 'en' AND modified >= '2024-02-01' AND modified <= '2024-12-31'")
def filter_notes(spark, d):
    n = notes(spark, d)
    first = n.agg(F.lower(F.min("project")).alias("p"))  # one row
    rows = n.where("type = 'en' and modified >= '2024-02-01' and modified <= '2024-12-31'")
    return rows.join(F.broadcast(first), F.lower("project") == F.col("p"), "left_semi").select("id", "title")


@query(f"WITH {NOTES} SELECT id, title, modified FROM notes WHERE modified >= '2024-06-01' AND (type IS NULL OR type NOT IN ('hub', 'concept', 'moc', 'meta', 'guide')) ORDER BY modified DESC, id LIMIT 30")
def recent_notes(spark, d):
    """The 30 latest, a top-k report."""
    n = notes(spark, d).where((F.col("modified") >= "2024-06-01") & (F.col("type").isNull() | ~F.col("type").isin(*STRUCTURAL)))
    return n.orderBy(F.desc("modified"), "id").limit(30).select("id", "title", "modified")


@query(f"WITH {NOTES} SELECT id, path FROM notes ORDER BY path, id LIMIT 50")
def list_notes(spark, d):
    """The first page of the list."""
    return notes(spark, d).orderBy("path", "id").limit(50).select("id", "path")


@query(f"WITH {NOTES} SELECT id, path FROM notes ORDER BY path, id LIMIT 20 OFFSET 40")
def page_offset(spark, d):
    return notes(spark, d).orderBy("path", "id").offset(40).limit(20).select("id", "path")


@query(f"WITH {NOTES} SELECT type, project, count(*) AS n, max(modified) AS latest FROM notes GROUP BY ALL")
def notes_by_kind(spark, d):
    return notes(spark, d).groupBy("type", "project").agg(F.count("*").alias("n"), F.max("modified").alias("latest"))


@query(f"""WITH {NOTES}, r AS (SELECT project, type, id, modified, row_number() OVER (PARTITION BY project, type ORDER BY modified DESC, id) AS no, count(*) OVER (PARTITION BY project, type) AS total FROM notes)
SELECT project, type, id, no, total FROM r WHERE no <= 5""")
def project_briefing(spark, d):
    """The five latest notes of each kind in each project, with how many there are. A hot project is cut by kind and
    first to its five latest in each task's share of it."""
    n = notes(spark, d).select("project", "type", "id", "modified")
    totals = n.groupBy("project", "type").agg(F.count("*").alias("total"))
    top = C.top_of(n, ["project", "type"], [F.desc("modified"), F.col("id")], 5)
    same = top["project"].eqNullSafe(totals["project"]) & top["type"].eqNullSafe(totals["type"])
    return top.join(totals, same).select(top["project"], top["type"], "id", "no", "total")


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS no FROM events) WHERE no = 1")
def top1_per_group(spark, d):
    """A maximum needs no sort and is taken in each task first."""
    best = F.max(F.struct("ts", (-F.col("event_id")).alias("e"))).alias("b")
    return table(spark, d, "events").groupBy("user_id").agg(best).select("user_id", (-F.col("b.e")).alias("event_id"), F.col("b.ts").alias("ts"))


@query("SELECT user_id, event_id, no FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS no FROM events) WHERE no <= 3")
def topn_per_group(spark, d):
    return C.top_of(table(spark, d, "events"), ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "no")


@query(f"WITH {NOTES} SELECT id, path NOT LIKE '%/de/%' AND (visibility IS NULL OR visibility <> 'private') AND NOT (lower(path) LIKE '%/fr/%' AND NOT contains(substr(path, strpos(path, '/fr/') + 4), '/')) AS ok FROM notes")
def policy_readable(spark, d):
    ok = readable(F.col("path"), F.col("visibility"), ["**/de/**"], ["**/fr/*.md"], may_read_private=False)
    return notes(spark, d).select("id", ok.alias("ok"))


@query(f"WITH {NOTES} SELECT id, modified FROM notes WHERE path NOT LIKE '%/de/%' AND (visibility IS NULL OR visibility <> 'private') ORDER BY modified DESC, id LIMIT 25")
def policy_topk(spark, d):
    """The rule comes before the limit, so a page is never short of readable rows."""
    ok = readable(F.col("path"), F.col("visibility"), ["**/de/**"], [], may_read_private=False)
    return notes(spark, d).where(ok).orderBy(F.desc("modified"), "id").limit(25).select("id", "modified")


@query(r"""SELECT c_custkey, 'password = [REDACTED:credential-assignment] and ' || c_mktsegment AS shown, ['credential-assignment'] AS kinds FROM customer""")
def redact_text(spark, d):
    raw = F.concat(F.lit("password" + " = "), F.sha1(F.col("c_name")), F.lit(" and "), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", redacted(raw).alias("shown"), secret_kinds(raw).alias("kinds"))


_EVAL = """q AS (SELECT o_orderkey AS q, o_orderpriority AS cls, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 1 + o_custkey % 9 END AS rank, o_totalprice AS ms FROM orders)"""


def cases(spark, d):
    rank = F.when(F.col("o_orderkey") % 7 != 0, 1 + F.col("o_custkey") % 9)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_orderpriority").alias("cls"), rank.alias("rank"), F.col("o_totalprice").alias("ms"))


@query(f"WITH {_EVAL} SELECT cls, count(*) AS n, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, count(*) FILTER (rank IS NULL) AS refused FROM q GROUP BY cls")
def eval_metrics(spark, d):
    """Right first, in the first five, mean reciprocal rank and refusals of each class of questions."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    r = F.col("rank")
    return cases(spark, d).groupBy("cls").agg(
        F.count("*").alias("n"), share(r == 1).alias("top1"), share(r <= 5).alias("recall5"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"), F.count_if(r.isNull()).alias("refused")
    )


@query(f"WITH {_EVAL} SELECT cls, quantile_disc(ms, 0.5) AS median, quantile_disc(ms, 0.95) AS p95 FROM q GROUP BY cls")
def latency_percentiles(spark, d):
    """Lower median and nearest-rank 95th percentile, exact."""
    pick = lambda p: F.expr(f"percentile_disc({p}) within group (order by ms)")
    return cases(spark, d).groupBy("cls").agg(pick(0.5).alias("median"), pick(0.95).alias("p95"))


@query(f"""WITH {_EVAL}, s AS (SELECT cls, CASE WHEN rank IS NULL THEN 'retrieval' WHEN rank > 7 THEN 'shortlist' WHEN rank > 5 THEN 'rerank' WHEN rank > 3 THEN 'pack' ELSE 'kept' END AS lost FROM q)
SELECT cls, lost, count(*) AS n FROM s GROUP BY ALL""")
def eval_funnel(spark, d):
    """At which stage the right note was lost."""
    r = F.col("rank")
    lost = F.when(r.isNull(), "retrieval").when(r > 7, "shortlist").when(r > 5, "rerank").when(r > 3, "pack").otherwise("kept")
    return cases(spark, d).groupBy("cls", lost.alias("lost")).agg(F.count("*").alias("n"))


@query(f"WITH {_EVAL}, b AS (SELECT q, CASE WHEN q % 11 = 0 THEN NULL ELSE rank END AS rank FROM q) SELECT q.q, CASE WHEN coalesce(b.rank <= 5, false) THEN 'gained' ELSE 'lost' END AS change FROM q JOIN b ON b.q = q.q WHERE coalesce(q.rank <= 5, false) <> coalesce(b.rank <= 5, false)")
def eval_diff(spark, d):
    """Questions that a change of settings gained or lost."""
    a = cases(spark, d).select("q", F.coalesce(F.col("rank") <= 5, F.lit(False)).alias("x"))
    other = F.when(F.col("q") % 11 != 0, F.col("rank"))
    b = cases(spark, d).select("q", F.coalesce(other <= 5, F.lit(False)).alias("y"))
    return a.join(b, "q").where("x <> y").select("q", F.when(F.col("y"), "gained").otherwise("lost").alias("change"))


@query("SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS op, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def cdc_latest(spark, d):
    """The state after a change feed: the last change of each key, its number deciding."""
    feed = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"), "value")
    return C.latest(feed, "key", "seq")


@query("SELECT user_id AS key, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'refund'")
def merge_delete(spark, d):
    feed = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"), "value")
    return C.latest(feed, "key", "seq").where("op <> 'refund'").select("key", "value")


@query("""WITH new AS (SELECT c_custkey AS key, c_acctbal + 1 AS value FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 10000000, 0 FROM customer WHERE c_custkey % 5 = 0)
SELECT coalesce(n.key, o.c_custkey) AS key, coalesce(n.value, o.c_acctbal) AS value FROM customer o FULL JOIN new n ON n.key = o.c_custkey""")
def merge_upsert(spark, d):
    c = table(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") + 1).alias("value"))
    new = new.union(c.where("c_custkey % 5 = 0").select(F.col("c_custkey") + 10000000, F.lit(0.0)))
    return C.upserted(old, new, "key")


@query("SELECT count(*) AS removed FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def reindex_removed(spark, d):
    seen = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(seen, "o_orderkey", "left_anti").agg(F.count("*").alias("removed"))


@query(f"WITH {NOTES} SELECT n.id FROM notes n LEFT JOIN embeddings e ON e.vec_id = n.id WHERE e.vec_id IS NULL")
def embed_todo(spark, d):
    """Notes without a vector."""
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(have, "id", "left_anti")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def vec_orphans(spark, d):
    return table(spark, d, "embeddings").select("vec_id").join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, no""")
def debounce_sessions(spark, d):
    """Changes of a key that follow each other within the gap are one."""
    return C.sessions(table(spark, d, "events"), "ts", ["user_id"], "6 hours")


@query("SELECT event_type AS tool, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS calls, count(*) FILTER (value < 10) AS failed, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def audit_rollup(spark, d):
    return C.audit(table(spark, d, "events")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'refund' AND (last_ok IS NULL OR ts > last_ok)) AS failures
FROM (SELECT user_id, ts, event_type, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS last_ok FROM events) GROUP BY user_id""")
def failures_since_success(spark, d):
    """Failures after the last success of each key, without a window: each failure waits for its key's last success,
    one row a key."""
    e = table(spark, d, "events")
    ok = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("last_ok"))
    bad = e.where("event_type = 'refund'").join(ok, "user_id").where("last_ok is null or ts > last_ok").groupBy("user_id").agg(F.count("*").alias("failures"))
    return ok.join(bad, "user_id", "left").select("user_id", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))


@query("""SELECT event_id FROM events WHERE ts + CASE event_type WHEN 'purchase' THEN INTERVAL 7 DAY WHEN 'refund' THEN INTERVAL 30 DAY ELSE INTERVAL 1 HOUR END > TIMESTAMP '2024-01-20'""")
def ttl_purge(spark, d):
    """What outlives its time to live at a given moment."""
    return C.alive(table(spark, d, "events"), F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query("SELECT event_id, CASE WHEN length(args) > 600 THEN left(args, 600) || '...' ELSE args END AS args FROM (SELECT event_id, repeat(props, 1 + CAST(event_id % 100 AS INTEGER)) AS args FROM events)")
def audit_truncate(spark, d):
    """Arguments of calls, of up to a hundred copies of the properties, as the audit log keeps them."""
    args = F.repeat("props", (1 + F.col("event_id") % 100).cast("int"))
    return table(spark, d, "events").select("event_id", F.when(F.length(args) > 600, F.concat(F.left(args, F.lit(600)), F.lit("..."))).otherwise(args).alias("args"))
