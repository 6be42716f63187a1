"""The engine's relations over the parquet tables, in Spark and as SQL for comparison."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, TOKEN, query_terms, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes; private where labelled toxic."""
    labels = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit("private").alias("visibility"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    title = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)), 1, 3), " ")
    return docs.select(
        F.col("doc_id").alias("id"), title.alias("title"), F.col("lang").alias("type"), F.col("source").alias("project"),
        "visibility", F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 400).cast("int")), "yyyy-MM-dd").alias("modified"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("n_chars").alias("size"), F.col("text").alias("body"),
    )


NOTES = r"""notes AS (
  SELECT d.doc_id AS id, array_to_string(regexp_extract_all(text, '[\p{L}\p{N}]+')[1:3], ' ') AS title, lang AS type, source AS project,
         CASE WHEN t.doc_id IS NOT NULL THEN 'private' END AS visibility,
         strftime(DATE '2024-01-01' + CAST(d.doc_id % 400 AS INTEGER), '%Y-%m-%d') AS modified,
         source || '/' || lang || '/' || d.doc_id || '.md' AS path, n_chars AS size, text AS body
  FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t ON t.doc_id = d.doc_id
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, terms): the terms of each benchmark text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), query_terms(F.col("text")).alias("terms"))


STOP_SQL = ",".join(f"'{w}'" for w in STOP_WORDS)


def terms_sql(text: str) -> str:
    raw = rf"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}\s_-]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND w NOT IN ({STOP_SQL}))"
    return f"list_transform(list_filter(list_transform({raw}, lambda w, i: struct_pack(w := w, i := i)), lambda s: list_position({raw}, s.w) = s.i), lambda s: s.w)"


QUESTIONS = f"""questions AS (
  SELECT item_id AS query_id, {terms_sql("text")} AS terms FROM benchmark
)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, term, pos): the inverted index of the documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("key"), F.posexplode(tokens(F.col("text"))).alias("pos", "term"))


POSTINGS = r"""postings AS (
  SELECT key, unnest(t) AS term, unnest(range(len(t))) AS pos
  FROM (SELECT doc_id AS key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)
)"""
