"""Quality rules by host: rule failures of a host's documents, shrunk to what hosts do in general.

Everything is DataFrame expressions. A host's failure rate f / n says little when n is small, so it is shrunk with
a beta prior that is fitted to the rates of all hosts by their moments: (f + a) / (n + a + b). Hosts whose shrunk
rate is over the limit fail, and their documents with them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, stored, table

MIN_WORDS = 50
#: Per cent of the words that may stand in repeated 3-word windows.
MAX_REPEATED = 50
#: A host fails whose shrunk failure rate is above this.
MAX_RATE = 0.5
#: Weight of the prior in documents where the hosts' rates don't tell it (one host, or equal rates).
WEIGHT = 10.0


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, also where use() has it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(found: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Windows are compared by 64-bit hashes within the text."""

    def covered(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")),
        )

        def neighbours(s: Column) -> Column:  # equal windows are neighbours once sorted
            n = F.size(s) - 1
            both = F.zip_with(
                F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], a["p"] + 1, a["p"] + 2, b["p"], b["p"] + 1, b["p"] + 2)),
            )
            return F.size(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

        return let(F.sort_array(windows), neighbours)

    return F.when(F.size(found) < 4, 0).otherwise(let(found, covered)).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", F.col(host).alias("host"), "text", words(F.col("text")).alias("w"))
    rows = split.select(
        "doc_id", "host",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        repeated_lines(F.col("text")).alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """Of each host of measures(): (host, n, failed, rate, host_failed). A null host gets no verdict."""
    hosts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    hosts = hosts.withColumn("raw", F.col("failed") / F.col("n"))
    prior = hosts.agg(F.avg("raw").alias("m"), F.var_pop("raw").alias("v"))
    weight = F.when((F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(WEIGHT))
    prior = prior.select((F.col("m") * weight).alias("a"), weight.alias("ab"))
    # one row of two numbers
    hosts = hosts.join(F.broadcast(prior)).withColumn("rate", (F.col("failed") + F.col("a")) / (F.col("n") + F.col("ab")))
    return hosts.select("host", "n", "failed", "rate", (F.col("rate") > MAX_RATE).alias("host_failed"))


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """docs (doc_id, text string, host column, ...) -> measures() and kept boolean, a row for each row.

    kept: neither the document's own rules nor its host's shrunk rate fail. A null, empty or wordless text has
    zero in all counts and fails. Rows without a host are judged by themselves. Repeated rows count each.
    Texts are read whole, of any length; a text's windows are one array in its task.
    Further columns are ignored, so none can clash. No rows: no rows.
    """
    rows = stored(measures(docs, host), "quality")
    bad = host_verdicts(rows).where("host_failed").select("host", "host_failed")
    return beside(rows, bad, "host").select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_failed").isNull()).alias("kept"),
    )


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("host")


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k
  FROM (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE k > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed, count(*) FILTER (base_failed) / count(*) AS raw FROM f WHERE source IS NOT NULL GROUP BY source
), p AS (SELECT avg(raw) AS m, var_pop(raw) AS v FROM h),
q AS (SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 10 END AS ab FROM p),
bad AS (SELECT source FROM h, q WHERE (failed + m * ab) / (n + ab) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM f
"""
