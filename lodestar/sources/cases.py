"""Questions with their expected answers, for measuring retrieval."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

CASE = (
    "id string, cls string, category string, q string, query string, family string, gold array<string>, required array<string>, evidence string, qrels map<string,int>"
)
# The 32-bit FNV-1a hash, and what stands before an id when cases are split.
FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193
SALT = "brb:"


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's code units, as long."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    # 32 bits times 25 bits fit a long
    step = lambda h, c: F.pmod((h.bitwiseXOR(c)) * FNV_PRIME, F.lit(1 << 32))
    return F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(FNV_START).cast("long"), step)


@pandas_udf(StringType())
def evidence_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text as evidence is compared: NFKC, lower case, marks of emphasis and code off, white space folded."""
    for x in texts:
        yield x.str.normalize("NFKC").str.lower().str.replace(r"[*`_]", "", regex=True).str.replace(r"\s+", " ", regex=True).str.strip()


def cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, cls, question, gold, required, evidence array<array<string>>, offtopic, split) of a JSON file: a list of
    cases, or an object with one under `queries`.

    gold: as given, else what is required and graded 3 or more, else what is graded 2 or more; off-topic cases have
    none. Three in four cases with an id are for testing, the others for tuning, by a hash of the id or family.
    """
    raw = spark.read.text(path, wholetext=True)
    rows = F.coalesce(_listed("$.queries"), _listed("$"))
    return read(raw.select(F.posexplode(rows).alias("no", "c")).select("no", "c.*"))


def _listed(at: str) -> Column:
    fields = ", ".join(x.strip().replace(" ", ": ", 1) for x in CASE.split(", "))
    return F.from_json(F.get_json_object("value", at), f"array<struct<{fields}>>")


def read(rows: DataFrame) -> DataFrame:
    """cases() of rows (no, and the fields of a case)."""
    cls = F.coalesce("cls", "category", F.lit("other"))
    off = cls.isin("offtopic", "abstain")
    graded = lambda n: F.map_keys(F.map_filter(F.coalesce("qrels", F.create_map().cast("map<string,int>")), lambda k, v: v >= n))
    required = F.coalesce("required", F.array().cast("array<string>"))
    first = F.coalesce("gold", F.array_union(required, graded(3)))
    gold = F.when(off, F.array().cast("array<string>")).when(F.size(first) == 0, graded(2)).otherwise(first)
    groups = F.coalesce(F.from_json("evidence", "array<array<string>>"), F.transform(F.from_json("evidence", "array<string>"), lambda x: F.array(x)), F.array().cast("array<array<string>>"))
    split = F.when(F.col("id").isNull(), "all").when(fnv1a(F.concat(F.lit(SALT), F.coalesce("family", "id"))) % 4 == 0, "dev").otherwise("test")
    return rows.select(
        F.coalesce("id", F.concat(F.lit("case-"), (F.col("no") + 1).cast("string"))).alias("id"), cls.alias("cls"), F.coalesce("q", "query").alias("question"), gold.alias("gold"), required.alias("required"),
        groups.alias("evidence"), off.alias("offtopic"), split.alias("split"),
    )


def covered(cases: DataFrame, packs: DataFrame) -> DataFrame:
    """(id, n_groups, n_found, complete): of each case's groups of evidence those with a span in its pack's text (id,
    text). Both sides as evidence_text() has them."""
    spans = cases.select("id", F.posexplode("evidence").alias("no", "spans")).select("id", "no", F.explode("spans").alias("span")).withColumn("span", evidence_text("span")).where("span <> ''")
    texts = packs.select("id", evidence_text("text").alias("text"))
    hits = spans.join(texts, "id", "left").groupBy("id", "no").agg(F.bool_or(F.coalesce(F.contains("text", "span"), F.lit(False))).alias("hit"))
    return hits.groupBy("id").agg(F.count("*").alias("n_groups"), F.count_if("hit").alias("n_found"), F.bool_and("hit").alias("complete"))
