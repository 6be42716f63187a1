"""Changes to notes as columns and joins: sections replaced, notes captured, moved and deleted, links that break."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .sections import lines


def with_section(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, body, error) of notes (id, body) after edits (id, heading, content): the text below the heading, up to the
    next of its level or above, becomes the content. The heading must be there once, outside of fences; case doesn't
    count. One edit a note."""
    want = F.lower(F.trim(F.regexp_replace("h", r"^#+\s*", "")))
    rows = lines(notes).withColumnRenamed("heading", "own").join(edits.select("id", F.col("heading").alias("h"), "content"), "id")
    rows = rows.withColumn("hit", (F.col("level") > 0) & (F.lower(F.trim("own")) == want))
    found = rows.groupBy("id").agg(F.count_if("hit").alias("n"), F.min(F.when(F.col("hit"), F.struct("no", "level"))).alias("at"))
    rows = rows.join(found, "id")
    below = F.col("no") > F.col("at.no")
    ends = below & (F.col("level") > 0) & (F.col("level") <= F.col("at.level"))
    over = F.coalesce(F.max(ends).over(W.partitionBy("id").orderBy("no")), F.lit(False))
    kept = rows.withColumn("over", over).where((F.col("n") == 1) & (~below | F.col("over")))
    text = F.when(F.col("no") == F.col("at.no"), F.concat("line", F.lit("\n\n"), F.trim("content"), F.lit("\n"))).otherwise(F.col("line"))
    new = kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", text.alias("t")))), lambda x: x["t"]), "\n").alias("new"))
    state = edits.select("id").join(found.select("id", "n"), "id", "left").select("id", F.when(F.coalesce("n", F.lit(0)) == 0, "no such heading").when(F.col("n") > 1, "more than one such heading").alias("error"))
    return notes.select("id", "body").join(state, "id").join(new, "id", "left").select("id", F.coalesce("new", "body").alias("body"), "error")


def replaced_once(body: Column, old: Column, new: Column) -> Column:
    """body with `old` replaced, where it is there exactly once; else null."""
    n = (F.length(body) - F.length(F.replace(body, old, F.lit("")))) / F.length(old)
    return F.when((F.length(old) > 0) & (n == 1), F.replace(body, old, new))


def captured(items: DataFrame, there: DataFrame, folder: str, day: str) -> DataFrame:
    """(id, raw): new notes of items (title, text, project, topics array<string>), each in a file of its own below the
    folder; names that are taken, by notes `there` (id) or by others of the items, get a number."""
    name = F.trim(F.substring(F.regexp_replace(F.regexp_replace("title", r'[\[\]|#^\\/:*?"<>]', " "), r"\s+", " "), 1, 120))
    stem = F.concat(F.lit(folder + "/"), F.when(name == "", "Untitled").otherwise(name))
    taken = there.select(F.lower(F.regexp_replace("id", r"(?i)( \d+)?\.md$", "")).alias("k"), F.coalesce(F.nullif(F.regexp_extract("id", r"(?i) (\d+)\.md$", 1), F.lit("")).cast("int"), F.lit(1)).alias("n"))
    last = taken.groupBy("k").agg(F.max("n").alias("last"))
    rows = items.withColumn("stem", stem).join(last, F.lower("stem") == F.col("k"), "left")
    n = F.coalesce("last", F.lit(0)) + F.row_number().over(W.partitionBy(F.lower("stem")).orderBy("title", "text"))
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    topics = F.when(F.size("topics") > 0, F.concat(F.lit("topics:\n"), F.array_join(F.transform("topics", lambda t: F.concat(F.lit("  - "), quoted(F.concat(F.lit("[["), t, F.lit("]]"))))), "\n"), F.lit("\n")))
    project = F.when(F.col("project").isNotNull(), F.concat(F.lit("project: "), quoted(F.concat(F.lit("[["), F.col("project"), F.lit("]]"))), F.lit("\n")))
    head = F.concat(
        F.lit("---\ntitle: "), quoted(F.col("title")), F.lit("\ntype: note\n"), F.coalesce(project, F.lit("")), F.coalesce(topics, F.lit("")),
        F.lit(f"tags:\n  - captured\ncaptured: {day}\nmodified: {day}\n---\n\n"),
    )
    return rows.select(
        F.concat("stem", F.when(n > 1, F.concat(F.lit(" "), n.cast("string"))).otherwise(""), F.lit(".md")).alias("id"),
        F.concat(head, F.lit("# "), "title", F.lit("\n\n"), F.trim("text"), F.lit("\n")).alias("raw"),
    )


def without(notes: DataFrame, gone: DataFrame, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """notes, and each (children, their column of the note's id), without the notes `gone` (id)."""
    return [notes.join(gone.select("id"), "id", "left_anti")] + [c.join(gone.select(F.col("id").alias(key)), key, "left_anti") for c, key in children]


def upserted(old: DataFrame, new: DataFrame, *children: tuple[DataFrame, DataFrame, str]) -> list[DataFrame]:
    """The notes with `new` in place of theirs, and of each (old children, new children, their column of the note's id)
    the rows of other notes with the new ones."""
    ids = new.select("id")
    out = [old.join(ids, "id", "left_anti").unionByName(new)]
    for before, after, key in children:
        out.append(before.join(ids.select(F.col("id").alias(key)), key, "left_anti").unionByName(after))
    return out


def broken_links(before: DataFrame, after: DataFrame) -> DataFrame:
    """Links (from_id, to_id) that resolved before a change and don't any more."""
    resolved = lambda x: x.where("to_id is not null").select("from_id", "to_id").distinct()
    return resolved(before).join(resolved(after), ["from_id", "to_id"], "left_anti")
