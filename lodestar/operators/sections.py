"""Notes cut into sections by their headings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"


def lines(notes: DataFrame) -> DataFrame:
    """(id, no, line, level, heading) of notes (id, body); level 0 where a line is no heading or inside a fence."""
    rows = notes.select("id", F.posexplode(F.split("body", r"\r?\n")).alias("no", "line"))
    by = W.partitionBy("id").orderBy("no").rowsBetween(W.unboundedPreceding, -1)
    fenced = F.coalesce(F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(by), F.lit(0)) % 2 == 1
    head = F.regexp_extract("line", _HEADING, 1)
    level = F.when(fenced, 0).otherwise(F.length(head))
    return rows.withColumn("level", level).withColumn("heading", F.when(level > 0, F.regexp_extract("line", _HEADING, 2)))


def sections(notes: DataFrame) -> DataFrame:
    """(id, ord, heading, level, text): what stands before the first heading has an empty heading and level 0. Empty
    beginnings are no section."""
    rows = lines(notes)
    part = F.sum((F.col("level") > 0).cast("int")).over(W.partitionBy("id").orderBy("no"))
    rows = rows.withColumn("part", part)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("no", "line")))), lambda x: x["line"]), "\n")
    got = rows.groupBy("id", "part").agg(F.max("heading").alias("heading"), F.max("level").alias("level"), body.alias("text"))
    got = got.where((F.col("part") > 0) | (F.trim("text") != ""))
    ord_ = (F.row_number().over(W.partitionBy("id").orderBy("part")) - 1).alias("ord")
    return got.select("id", ord_, F.coalesce("heading", F.lit("")).alias("heading"), "level", "text")


def section_named(notes: DataFrame, heading: str) -> DataFrame:
    """(id, text): the section of that heading (case doesn't count), its subsections included; the first if several."""
    rows = lines(notes)
    named = rows.where((F.col("level") > 0) & (F.lower("heading") == heading.lower()))
    start = named.groupBy("id").agg(F.min(F.struct("no", "level")).alias("s")).select("id", F.col("s.no").alias("from"), F.col("s.level").alias("depth"))
    rows = rows.join(start, "id").where("no > from")
    ends = (F.col("level") > 0) & (F.col("level") <= F.col("depth"))
    over = F.coalesce(F.max(ends).over(W.partitionBy("id").orderBy("no")), F.lit(False))
    kept = rows.withColumn("over", over).where(~F.col("over"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("id").agg(F.trim(text).alias("text"))
