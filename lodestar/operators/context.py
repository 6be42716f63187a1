"""What is handed on of the notes: packs of sections for a question, the identity bundle, views of a note."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import STOP_WORDS, title_overlap
from ..lineage import cut
from .graph import STRUCTURAL
from .retrieval import RRF_K, packed, told
from .running import running_sum

# What note rank, a link with a top hit, a late change, title and heading are worth beside a section's rank.
NOTE_SHARE, LINKED, LATE, LATE_DAYS, TITLE, HEADING = 0.7, 0.004, 0.002, 90, 0.02, 0.01
BUDGET, SECTION_CHARS, PER_NOTE, MOST, TOP = 18_000, 3_500, 3, 10, 3
CUT = "\n[… section truncated]"


def lexical_candidates(queries: DataFrame, section_hits: DataFrame, note_hits: DataFrame, notes: DataFrame, sections: DataFrame, linked: DataFrame, today: str) -> DataFrame:
    """(query_id, note, ord, score, rank) of sections that answer queries (query_id, terms).

    section_hits (query_id, note, ord, rank) and note_hits (query_id, note, rank) count from 1; notes (id, title, type,
    modified), sections (id, ord, heading), linked (a, b) both ways. A note without a section hit comes by its first
    section. Structural notes leave where others are left.
    """
    top = note_hits.where(F.col("rank") <= TOP).select("query_id", "note")
    both = linked.select("a", "b").union(linked.select("b", "a"))
    near = top.join(both, top["note"] == both["a"]).select("query_id", F.col("b").alias("note"), F.lit(LINKED).alias("near")).distinct()
    by_note = note_hits.select("query_id", "note", (NOTE_SHARE / (RRF_K + F.col("rank") - 1)).alias("by_note"))
    hits = section_hits.select("query_id", "note", "ord", (1 / (RRF_K + F.col("rank") - 1)).alias("by_section")).join(near, ["query_id", "note"], "left").join(by_note, ["query_id", "note"], "left")
    hits = hits.select("query_id", "note", "ord", (F.col("by_section") + F.coalesce("by_note", F.lit(0.0)) + F.coalesce("near", F.lit(0.0))).alias("base"))
    whole = by_note.join(hits.select("query_id", "note").distinct(), ["query_id", "note"], "left_anti").select("query_id", "note", F.lit(0).alias("ord"), F.col("by_note").alias("base"))
    rows = hits.union(whole).join(notes.select(F.col("id").alias("note"), "title", "type", "modified"), "note").join(sections.select(F.col("id").alias("note"), "ord", "heading"), ["note", "ord"]).join(queries.select("query_id", "terms"), "query_id")
    late = F.when(F.datediff(F.lit(today).cast("date"), F.to_date("modified")) < LATE_DAYS, LATE).otherwise(0.0)
    heading = F.when(F.col("ord") > 0, HEADING * title_overlap(F.col("heading"), F.col("terms"))).otherwise(0.0)
    rows = rows.withColumn("score", F.col("base") + late + TITLE * title_overlap(F.col("title"), F.col("terms")) + heading)
    structural = F.col("type").isin(*STRUCTURAL)
    content = F.count_if(~structural).over(W.partitionBy("query_id"))
    rows = rows.withColumn("content", content).where(~structural | (F.col("content") == 0))
    w = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "note", "ord")
    return rows.select("query_id", "note", "ord", "score", F.row_number().over(w).alias("rank"))


def pack(ranked: DataFrame, sections: DataFrame, budget: int = BUDGET, per_note: int = PER_NOTE, most: int = MOST, chars: int = SECTION_CHARS) -> DataFrame:
    """(query_id, rank, note, ord, text) of ranked (query_id, note, ord, rank) that fit: at most per_note of a note and
    `most` in all, the first whatever its size; texts cut at `chars`. sections (id, ord, text)."""
    rows = cut(sections.select(F.col("id").alias("note"), "ord", "text").join(told(cut(ranked)), ["note", "ord"]))  # no text is shuffled
    kept = packed(rows.select("query_id", "rank", "note", F.least(F.length("text"), F.lit(chars)).alias("size")), budget, per_note, most, one_anyway=True)
    text = F.when(F.length("text") > chars, F.concat(F.rtrim(F.left("text", F.lit(chars))), F.lit(CUT))).otherwise(F.col("text"))
    return rows.join(kept.select("query_id", "rank"), ["query_id", "rank"], "left_semi").select("query_id", "rank", "note", "ord", text.alias("text"))


def flagged(pack: DataFrame, facts: DataFrame) -> DataFrame:
    """pack with the flag of the fact a section tells of in front: facts (note, ord, flag), null where it is current."""
    rows = pack.join(facts.select("note", "ord", "flag"), ["note", "ord"], "left")
    return rows.withColumn("text", F.when(F.col("flag").isNotNull(), F.concat(F.lit("["), "flag", F.lit("]\n"), "text")).otherwise(F.col("text"))).drop("flag")


def rendered(pack: DataFrame, notes: DataFrame) -> DataFrame:
    """(query_id, n_sections, n_notes, text): notes in the order of their best section, sections in theirs."""
    titles = notes.select(F.col("id").alias("note"), "title").join(told(pack.select("note").distinct()), "note", "left_semi")
    rows = pack.join(titles, "note")
    by = rows.groupBy("query_id", "note", "title").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    cell = F.struct("first", F.concat(F.lit("## "), "title", F.lit(" `"), F.col("note").cast("string"), F.lit("`\n\n"), "text").alias("text"))
    return by.groupBy("query_id").agg(F.sum("n").alias("n_sections"), F.count("*").alias("n_notes"), F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["text"]), "\n\n---\n").alias("text"))


def within(parts: DataFrame, by: str, budget: int) -> DataFrame:
    """parts (by, no, text) in order until one doesn't fit the budget: it and all after it are left out."""
    used = F.sum(F.length("text")).over(W.partitionBy(by).orderBy("no").rowsBetween(W.unboundedPreceding, 0))
    return parts.withColumn("used", used).where(F.col("used") <= budget).drop("used")


def capped(text: Column, most: int, mark: str = "\n[… truncated]") -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit(mark))).otherwise(text)


def capped_newest(text: Column, most: int) -> Column:
    """The end of a text of blocks that fits, from the beginning of a block on."""
    tail = F.right(text, F.lit(most))
    at = F.instr(tail, "\n## ")
    return F.when(F.length(text) <= most, text).when(at > 0, F.substring(tail, at + 1, F.lit(most))).otherwise(tail)


#: A term of a topic that more than this share of the memory has says nothing; notes that stay where a topic tells nothing.
TOO_COMMON, NEWEST = 0.4, 5
FACT_CHARS = 300


def about(memory: DataFrame, topic: str) -> DataFrame:
    """The notes (id, title, modified, text, topics array<string>, ...) of a memory that a topic is about.

    A note is about it if its title, topics or first 3,000 characters have one of the topic's terms (in any form, from
    four letters on), of those that at most 40 % of the notes have. Where no term or note is left, the five newest are.
    """
    terms = query_terms_of(topic)
    hay = F.lower(F.concat_ws(" ", "title", F.array_join(F.coalesce("topics", F.array().cast("array<string>")), " "), F.left("text", F.lit(3_000))))
    hit = lambda t: F.contains(F.col("_hay"), F.lit(t[: max(4, len(t) - 1)])) if len(t) >= 4 else F.col("_hay").rlike(rf"\b{re.escape(t)}\b")
    rows = memory.withColumn("_hay", F.coalesce(hay, F.lit("")))
    counts = rows.agg(F.count("*").alias("n"), *(F.count_if(hit(t)).alias(f"t{k}") for k, t in enumerate(terms))).first()  # a number a term
    telling = [t for k, t in enumerate(terms) if counts[f"t{k}"] <= TOO_COMMON * counts["n"]]
    newest = memory.orderBy(F.desc("modified"), "id").limit(NEWEST)
    if not telling or not any(counts[f"t{k}"] for k, t in enumerate(terms) if t in telling):
        return newest
    found = hit(telling[0])
    for t in telling[1:]:
        found = found | hit(t)
    return rows.where(found).drop("_hay")


def query_terms_of(topic: str) -> list[str]:
    """query_terms() of one text that is known when the query is made."""
    words = re.split(r"\s+", re.sub(r"[^\w\s-]", " ", topic.lower()))
    return list(dict.fromkeys(w for w in words if len(w) > 1 and w not in STOP_WORDS))


def identity(
    profile: DataFrame, memory: DataFrame, facts: DataFrame, skills: DataFrame, projects: DataFrame, recent: DataFrame, budget: int = 60_000, reserve: int = 8_000, note_chars: int = 2_500, topic: str | None = None,
    facts_budget: int = 4_000,
) -> DataFrame:
    """(part, no, text): who the owner is, in order. Profile first; memory notes, newest first, while the budget stays
    above the reserve, those about the topic if there is one; facts, newest first, while they fit a budget of their own;
    then skills, projects and what changed late, each whole.

    All have (id, title, type, modified, text), and memory has topics where a topic is given. What fits is found from
    sizes alone; texts are joined to what is left, so a memory of any size is no single task's work.
    """
    newest = [F.desc("modified"), F.col("id")]
    first = profile.select(F.lit(1).alias("part"), F.lit(1).alias("no"), F.concat(F.lit("## Who they are\n\n"), capped(F.col("text"), note_chars)).alias("text"))
    spent = F.broadcast(first.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("spent")))  # one number
    number = F.row_number().over(W.orderBy(*newest)).alias("no")  # of ids that fit a budget, or of a short list

    def fitting(rows: DataFrame, text: Column, fits: Column) -> DataFrame:
        sizes = running_sum(rows.select("id", "modified", F.length(text).alias("size")), F.col("size"), newest)
        return sizes.crossJoin(spent).where(fits).select("id", "modified").select("id", number)

    def written(rows: DataFrame, order: DataFrame, part: int, text: Column) -> DataFrame:
        return rows.join(order, "id").select(F.lit(part).alias("part"), "no", text.alias("text"))

    told = memory if topic is None else about(memory, topic)
    chunk = F.concat(F.lit("### "), "title", F.lit(" · "), "type", F.lit(" · "), "modified", F.lit("\n\n"), capped(F.col("text"), note_chars))
    line = lambda most: F.concat(F.lit("- **"), "title", F.lit("** — "), capped(F.coalesce("text", F.lit("")), most, "…"))
    rows = first.union(written(told, fitting(told, chunk, F.lit(budget) - F.col("spent") - F.col("used") >= reserve), 2, chunk))
    rows = rows.union(written(facts, fitting(facts, line(FACT_CHARS), F.col("used") <= facts_budget), 3, line(FACT_CHARS)))
    for part, (df, most) in enumerate(((skills, 300), (projects, 240), (recent, 200)), 4):
        rows = rows.union(written(df, df.select("id", "modified").select("id", number), part, line(most)))
    return rows


def graph_view(id_: str, links: DataFrame, notes: DataFrame, topics: DataFrame, most: int = 100) -> DataFrame:
    """(part, group, no, other, title) of one note: what it links to, what links to it by project and newest first, and
    the notes that share most topics. links (a, b), notes (id, title, project, modified), topics (id, topic)."""
    about = notes.select(F.col("id").alias("other"), "title", F.coalesce("project", F.lit("")).alias("project"), "modified")
    out = links.where(F.col("a") == id_).select(F.col("b").alias("other")).distinct().join(about, "other")
    out = out.select(F.lit("out").alias("part"), F.lit("").alias("group"), F.row_number().over(W.orderBy("title", "other")).alias("no"), "other", "title")
    back = links.where((F.col("b") == id_) & (F.col("a") != id_)).select(F.col("a").alias("other")).distinct().join(about, "other").orderBy(F.desc("modified"), "other").limit(most)
    back = back.select(F.lit("back").alias("part"), F.col("project").alias("group"), F.row_number().over(W.partitionBy("project").orderBy(F.desc("modified"), "other")).alias("no"), "other", "title")
    mine = topics.where(F.col("id") == id_).select("topic")
    near = topics.where(F.col("id") != id_).join(F.broadcast(mine), "topic").groupBy(F.col("id").alias("other")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("topic")), "|").alias("group"))
    near = near.join(about, "other").orderBy(F.desc("n"), "other").limit(most)
    near = near.select(F.lit("topics").alias("part"), "group", F.row_number().over(W.orderBy(F.desc("n"), "other")).alias("no"), "other", "title")
    return out.union(back).union(near)


def read_view(notes: DataFrame, edges: DataFrame, most_links: int = 25) -> DataFrame:
    """(id, title, text, links) of notes (id, title, body) with the titles they link to, edges (a, title), each once in
    order of its first place, at most most_links of them."""
    first = edges.groupBy("a", "title").agg(F.min("pos").alias("pos"))
    told = first.groupBy(F.col("a").alias("id")).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), 1, most_links).alias("links"))
    return notes.join(told, "id", "left").select("id", "title", F.col("body").alias("text"), F.coalesce("links", F.array().cast("array<string>")).alias("links"))
