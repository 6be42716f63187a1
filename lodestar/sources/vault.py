"""A folder of Markdown notes as relations: notes, sections, edges, titles."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown

_SECTION = "struct<ord: int, heading: string, level: int, text: string>"
_EDGE = "struct<pos: int, from_ord: int, kind: string, fm_key: string, target: string, heading: string, ctx: string, line: int, col: int>"
NOTE = (
    "id string, title string, type string, project string, visibility string, source string, modified string, captured string, size long, frontmatter string, "
    f"body string, topics array<string>, related array<string>, tags array<string>, aliases array<string>, links array<string>, sections array<{_SECTION}>, edges array<{_EDGE}>"
)


def scan(spark: SparkSession, folder: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(id, raw, day): the .md files below a folder. Folders named in `ignored` (at the top) and all whose name begins
    with a dot are left out, and files of no bytes, which Spark's file sources pass over. id is the path below the
    folder, day that of the last change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dD]").load(folder)
    path = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    root = folder.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    id_ = F.substring_index(path, f"{root}/", -1)
    rows = files.select(id_.alias("id"), F.col("content").cast("string").alias("raw"), F.date_format("modificationTime", "yyyy-MM-dd").alias("day"))
    hidden = F.exists(F.split("id", "/"), lambda x: x.startswith("."))
    return rows.where(~hidden & ~F.element_at(F.split("id", "/"), 1).isin(list(ignored)))


def parsed(raw: DataFrame) -> DataFrame:
    """Notes of (id, raw, day), with their sections and edges as arrays. A note that can't be read as such is all body;
    a null text is an empty one."""
    schema = raw.sparkSession.createDataFrame([], NOTE).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = [markdown.note(x["id"], x["raw"] or "", x["day"]) for x in batch.slice(lo, 64).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return raw.select("id", "raw", "day").mapInArrow(run, schema)


def notes(rows: DataFrame) -> DataFrame:
    return rows.drop("sections", "edges")


def sections(rows: DataFrame) -> DataFrame:
    """(id, ord, heading, level, text): windows; those without a heading have the note's title."""
    cut = rows.select("id", "title", F.inline("sections"))
    return cut.withColumn("heading", F.when(F.col("heading") == "", F.col("title")).otherwise(F.col("heading"))).drop("title")


def edges(rows: DataFrame) -> DataFrame:
    """(from_id, pos, from_ord, kind, fm_key, target, heading, ctx): a row for each link as written."""
    return rows.select(F.col("id").alias("from_id"), F.inline("edges")).drop("line", "col")


def titles(rows: DataFrame) -> DataFrame:
    """(name, id): lower-cased titles, file names and aliases, each once."""
    base = F.regexp_replace(F.element_at(F.split("id", "/"), -1), r"(?i)\.md$", "")
    names = F.concat(F.array("title", base), F.coalesce("aliases", F.array().cast("array<string>")))
    return rows.select(F.explode(F.transform(names, F.lower)).alias("name"), "id").distinct()


def links(rows: DataFrame) -> DataFrame:
    """(from_id, target): what a note links to by its text and link keys, lower-cased, each once."""
    return rows.select(F.col("id").alias("from_id"), F.explode("links").alias("target")).select("from_id", F.lower("target").alias("target")).distinct()


def reindexed(stored: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, ids removed): after a scan exactly its notes are there."""
    return scanned, stored.select("id").join(scanned.select("id"), "id", "left_anti")


def in_reading_order(notes: DataFrame) -> DataFrame:
    return notes.orderBy("id")
