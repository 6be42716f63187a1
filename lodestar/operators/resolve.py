"""What the links of notes point at: names by stages, reduced to one note each before links meet them.

A link is looked up as a full path, the end of a path, both of these with words joined alike, a title, a file's name, an
alias, and last with the words of a name joined alike. The first stage that knows the name decides; of several notes
there the one in the folder of the linking note counts, then the shortest path, then the first id. Names that many notes
share are reduced to their best note, overall and by folder, so a hot title is one row for a link, not as many as notes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key, slug_key, strip_link

#: Stages in order, with how a link's name is written to meet their names.
STAGES = ("path", "suffix", "path slug", "suffix slug", "title", "file", "alias", "slug")
PLAIN, PATH_SLUG, SLUG = "plain", "path slug", "slug"


def folder(id: Column) -> Column:
    """The folder of a path, "" at the top."""
    return F.regexp_replace(id, r"(^|/)[^/]*$", "")


def _joined(segments: Column, fold) -> Column:
    return F.array_join(F.transform(segments, fold), "/")


def names(notes: DataFrame) -> DataFrame:
    """notes (id, title, aliases array<string>, ...) -> (way, name, stage, id): every name of every note, how a link has
    to be written to meet it, and the stage's number. Empty names and null titles aren't names."""
    path = F.split(F.regexp_replace("id", r"(?i)\.md$", ""), "/")
    ends = F.filter(F.sequence(F.lit(1), F.size(path)), lambda i: i < F.size(path) - 1)
    suffixes = F.transform(ends, lambda i: F.slice(path, i + 1, F.size(path) - i))
    file, title = F.element_at(path, -1), F.coalesce("title", F.lit(""))
    aliases = F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()), lambda a: name_key(strip_link(a)))
    one = lambda way, stage, name: F.struct(F.lit(way).alias("way"), F.lit(STAGES.index(stage)).alias("stage"), name.alias("name"))
    all_ = F.concat(
        F.array(
            one(PLAIN, "path", _joined(path, name_key)), one(PATH_SLUG, "path slug", _joined(path, slug_key)), one(PLAIN, "title", name_key(title)), one(PLAIN, "file", name_key(file)),
            one(SLUG, "slug", slug_key(title)), one(SLUG, "slug", slug_key(name_key(file))),
        ),
        F.transform(suffixes, lambda s: one(PLAIN, "suffix", _joined(s, name_key))), F.transform(suffixes, lambda s: one(PATH_SLUG, "suffix slug", _joined(s, slug_key))),
        F.transform(aliases, lambda a: one(PLAIN, "alias", a)), F.transform(aliases, lambda a: one(SLUG, "slug", slug_key(a))),
    )
    return notes.select("id", F.inline(all_)).where("name <> ''").select("way", "name", "stage", "id")


def dictionary(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """names() -> (a row for each way and name: its first stage, the best note there and how many notes share it; a row
    for each way, name and folder: the same within the folder)."""
    best = F.min(F.struct(F.length("id").alias("size"), "id")).alias("best")
    first = lambda keys: named.groupBy(*keys, "stage").agg(best, F.count_distinct("id").alias("n"))
    lowest = F.min(F.struct("stage", F.col("best.id").alias("id"), "n")).alias("x")
    overall = first(["way", "name"]).groupBy("way", "name").agg(lowest).select("way", "name", "x.*")
    near = named.withColumn("folder", folder(F.col("id"))).groupBy("way", "name", "folder", "stage").agg(best).groupBy("way", "name", "folder")
    near = near.agg(F.min(F.struct("stage", F.col("best.id").alias("id"))).alias("x")).select("way", "name", "folder", F.col("x.stage").alias("near_stage"), F.col("x.id").alias("near_id"))
    return overall, near


def resolved(links: DataFrame, notes: DataFrame, shorthands: dict[str, str] | None = None) -> DataFrame:
    """links (from_id, target, ...) with to_id, stage and n: the note each points at, by which stage, and how many notes
    have the name there; null where there is none.

    shorthands, a small table of settings, gives longer names for some (folded) names, which are tried where nothing has
    the name itself. Null or blank targets point nowhere. A note may point at itself. Links that say the same from one
    folder are looked up once.
    """
    key = lambda c: name_key(F.col(c))
    asked = links.select(folder(F.col("from_id")).alias("folder"), key("target").alias("key")).where("key <> ''").distinct()
    ways = lambda k, later: F.filter(
        F.array(
            F.struct(F.lit(PLAIN).alias("way"), k.alias("name"), F.lit(later).alias("later")),
            F.struct(F.lit(PATH_SLUG).alias("way"), F.when(F.contains(k, F.lit("/")), _joined(F.split(k, "/"), slug_key)).alias("name"), F.lit(later).alias("later")),
            F.struct(F.lit(SLUG).alias("way"), slug_key(k).alias("name"), F.lit(later).alias("later")),
        ),
        lambda x: x["name"].isNotNull() & (x["name"] != ""),
    )
    tried = ways(F.col("key"), 0)
    if shorthands:
        longer = F.create_map(*(F.lit(x) for pair in shorthands.items() for x in pair))[F.col("key")]
        tried = F.concat(tried, F.when(longer.isNotNull(), ways(name_key(longer), len(STAGES))).otherwise(F.slice(tried, 1, 0)))
    overall, near = dictionary(names(notes))
    met = asked.select("folder", "key", F.inline(tried)).join(overall, ["way", "name"]).join(near, ["way", "name", "folder"], "left")
    to = F.when(F.col("near_stage") == F.col("stage"), F.col("near_id")).otherwise(F.col("id"))
    found = met.groupBy("folder", "key").agg(F.min(F.struct((F.col("stage") + F.col("later")).alias("at"), to.alias("to_id"), "stage", "n")).alias("x"))
    found = found.select(F.col("folder").alias("_folder"), F.col("key").alias("_key"), "x.to_id", F.element_at(F.array(*map(F.lit, STAGES)), F.col("x.stage") + 1).alias("stage"), "x.n")
    rows = links.withColumn("_folder", folder(F.col("from_id"))).withColumn("_key", key("target"))
    return rows.join(found, ["_folder", "_key"], "left").drop("_folder", "_key")


def ambiguous(resolved_links: DataFrame) -> DataFrame:
    """(name, n): the names of links that several notes have where they were found."""
    return resolved_links.where("n > 1").groupBy(name_key(F.col("target")).alias("name")).agg(F.max("n").alias("n"))
