"""Dates that questions name and sections hold word for word, which words of an index don't keep together."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .changes import top_of

ISO = r"\d{4}-\d{2}-\d{2}"
MOST = 40


def dates_of(question: Column) -> Column:
    """The ISO dates that stand by themselves in a question, in order, repeated ones too."""
    return F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(rf"\b({ISO})\b"), F.lit(1))


def date_index(sections: DataFrame) -> DataFrame:
    """(date, note, ord): each date that a section (note, ord, text) holds anywhere, also inside a longer run of digits."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"(?=({ISO}))"), F.lit(1)))
    return sections.select("note", "ord", F.explode(found).alias("date")).select("date", "note", "ord")


def date_hits(index: DataFrame, asked: DataFrame, most: int = MOST) -> DataFrame:
    """(query_id, note, ord, date, rank): for each date of a question (query_id, dates), in its order, the first `most`
    sections that hold it by note and ord; so a section with two of the dates is there twice. Of index only what may be
    seen is to be given, as nothing hidden may take a place. A date that very many sections hold is cut in parts first.
    """
    wanted = asked.select("query_id", F.posexplode("dates").alias("nth", "date"))
    days = wanted.select("date").distinct()
    best = top_of(index.join(days, "date", "left_semi"), ["date"], [F.col("note"), F.col("ord")], most)
    rows = wanted.join(best, "date")
    return rows.select("query_id", "note", "ord", "date", F.row_number().over(W.partitionBy("query_id").orderBy("nth", "no")).alias("rank"))
