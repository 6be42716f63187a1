"""URL filters: rules by host and path, and for the rest trust and distrust propagated over the link graph.

Trust flows along links from hosts with allowed pages (personalised PageRank), distrust against them from hosts with
blocked pages: who links to bad hosts is suspect. Links to other hosts come from the pages' hrefs with a scheme or //. A host
whose distrust is over the limit and over its trust is blocked.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, cut, stored, table

#: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ROUNDS = 10
DAMPING = 0.85
#: Distrust, as a multiple of an equal share of all distrust, above which a host may be blocked.
LIMIT = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty where it is null or has no ://."""
    rest = F.expr(f"case when instr({url}, '://') > 0 then substring({url}, instr({url}, '://') + 3) else '' end")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.expr(f"case when instr({url}, '://') > 0 then regexp_replace(substring({url}, instr({url}, '://') + 3), '^[^/?#]*', '') else '' end")
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(tail, r"^[^?#]*", 0)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or null."""
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):  # a longer one overrides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def links(pages: DataFrame) -> DataFrame:
    """(a, b, w): pages of host a link w times to host b. Relative links stay on the host and don't count."""
    target = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""), F.lit(1)))
    found = pages.where(F.col("html").contains("//")).select(F.col("host").alias("a"), target.alias("url"))
    found = found.withColumn("url", F.when(F.col("url").startswith("//"), F.concat(F.lit("x:"), "url")).otherwise(F.col("url")))
    found = found.select("a", host_and_path()[0].alias("b")).where("b <> '' and a <> '' and a <> b")
    return found.groupBy("a", "b").agg(F.count("*").alias("w"))


def propagated(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank: edges (a, b, w), seeds (host, s) -> (host, score) of hosts that mass reaches.

    Seeds are scaled to a sum of 1. Each round a host keeps its share of the seeds and gives the rest of what it has
    to its neighbours by weight; hosts without links give nothing on. Lineage is cut every few rounds.
    """
    total = seeds.agg(F.sum("s").alias("all"))
    seeds = cut(seeds.join(F.broadcast(total)).select("host", (F.col("s") / F.col("all")).alias("s")))  # one row
    out = edges.groupBy("a").agg(F.sum("w").alias("out"))
    share = cut(edges.join(out, "a").select("a", "b", (F.col("w") / F.col("out")).alias("share")))
    if share.isEmpty() or seeds.isEmpty():
        return seeds.select("host", ((1 - damping) * F.col("s")).alias("score"))
    rank = seeds.select("host", F.col("s").alias("score"))
    for k in range(rounds):
        flow = share.join(rank, share["a"] == rank["host"]).select(F.col("b").alias("host"), (damping * F.col("share") * F.col("score")).alias("x"))
        base = seeds.select("host", ((1 - damping) * F.col("s")).alias("x"))
        rank = base.union(flow).groupBy("host").agg(F.sum("x").alias("score"))
        if k % 3 == 2:
            rank = cut(rank)
    return rank


def filtered(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url string, html string, ...) -> (page_id, host, path, rule, verdict, trust, distrust), a row each.

    host and path are empty where url is null or has no ://; such pages are judged as the host '' that nothing
    reaches. rule is the longest that fits (ties: the later by name), verdict its own, else that of the graph:
    block where the host's distrust is above LIMIT equal shares and above its trust, else allow. Null html has no
    links; repeated rows count each, equal hosts are one. Urls and pages are read whole, of any length. Further columns are ignored. No rows: no rows.
    """
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    edges = cut(links(rows))
    rows = stored(rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled")), "pages")
    seed = lambda kind: rows.where((F.col("ruled") == kind) & (F.col("host") != "")).groupBy("host").agg(F.count("*").cast("double").alias("s"))
    trust = propagated(edges, seed("allow")).withColumnRenamed("score", "trust")
    distrust = propagated(edges.selectExpr("b as a", "a as b", "w"), seed("block")).withColumnRenamed("score", "distrust")
    hosts = rows.select("host").distinct().join(trust, "host", "left").join(distrust, "host", "left")
    hosts = hosts.select("host", F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"))
    n = hosts.agg(F.count_if(F.col("distrust") > 0).alias("n"), F.sum("distrust").alias("all"))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") * F.col("n") > LIMIT * F.col("all"))
    hosts = cut(hosts.join(F.broadcast(n)).select("host", "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("own")))  # one row
    return beside(rows, hosts, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "own").alias("verdict"), "trust", "distrust"
    )


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def _rank_sql(name: str, seeds: str, a: str, b: str) -> str:
    """ROUNDS rounds of propagated() as common table expressions."""
    out = f"""
{name}s AS MATERIALIZED (SELECT host, s / sum(s) OVER () AS s FROM (SELECT host, cast(count(*) AS DOUBLE) AS s FROM r WHERE ruled = '{seeds}' AND host <> '' GROUP BY host)),
{name}e AS MATERIALIZED (SELECT {a} AS a, {b} AS b, w / sum(w) OVER (PARTITION BY {a}) AS share FROM e),
{name}0 AS MATERIALIZED (SELECT host, CASE WHEN EXISTS (FROM e) THEN s ELSE 0.15 * s END AS score FROM {name}s),"""
    for k in range(1, ROUNDS + 1):
        out += f"""
{name}{k} AS MATERIALIZED (SELECT host, sum(x) AS score FROM (SELECT host, 0.15 * s AS x FROM {name}s UNION ALL SELECT b, 0.85 * share * score FROM {name}e JOIN {name}{k - 1} ON a = host) GROUP BY host),"""
    return out


SQL = rf"""
WITH u AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u
), rules(kind, rh, rp) AS (VALUES {", ".join(map(str, RULES))}),
f AS (
  SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(kind, length(rh || rp)) AS ruled
  FROM h, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
), r AS (SELECT h.page_id, host, path, rule, ruled FROM h LEFT JOIN f ON f.page_id = h.page_id),
l AS (
  SELECT host AS a, unnest(regexp_extract_all(html, 'href\s*=\s*["'']?([A-Za-z][A-Za-z0-9+.-]*://[^"''\s>]*)', 1)) AS url FROM h
), e AS (
  SELECT a, b, count(*) AS w
  FROM (SELECT a, translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS b FROM l)
  WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b
),{_rank_sql("t", "allow", "a", "b")}{_rank_sql("d", "block", "b", "a")}
v AS (
  SELECT host, round(coalesce(t{ROUNDS}.score, 0), 9) AS trust, round(coalesce(d{ROUNDS}.score, 0), 9) AS distrust
  FROM (SELECT DISTINCT host FROM r) LEFT JOIN t{ROUNDS} USING (host) LEFT JOIN d{ROUNDS} USING (host)
), n AS (SELECT count(*) FILTER (distrust > 0) AS n, sum(distrust) AS s FROM v)
SELECT page_id, r.host, path, rule,
       coalesce(ruled, CASE WHEN distrust > trust AND distrust * n > 1.0 * s THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN v ON v.host = r.host, n
"""
