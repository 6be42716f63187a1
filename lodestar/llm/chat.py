"""Chat formatting by quotation linking.

Messages quote each other as in mail: a line's level is the number of > marks before it. Runs of lines with one level
are cut at blank lines into passages, normalised (marks off, white space folded, lower case) and hashed, as are the
lines of passages of several. A quoted passage belongs to the latest earlier message of its conversation that wrote
it, as a passage or a line, else to the first message of another conversation that did. A message answers the one that
its least nested linked passage comes from (ties: the last such passage), and where no whole passage of that level
links, or only earlier ones, a line counts at its own place. Else it answers the message before it. Links to other
conversations can form rings; each ring loses the link with the smallest (conv_id, turn) of those that lead to a larger
one. Conversations are then put in reply order, without the quotes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, stored, table

#: Passages and lines shorter than this many characters, normalised, are too common to link conversations by; within
#: their own they do.
LEAST_CHARS = 12
_MARKS = r"^(?:[ \t]*>)+"


def passages(text: Column) -> Column:
    """array<struct<at int, level int, body string, lines array<string>>>: the passages of a text in order, normalised.
    at is the last line's number."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    parsed = F.transform(
        lines,
        lambda x, k: F.struct(
            k.alias("at"),
            F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 0), "[^>]", "")).alias("level"),
            F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, _MARKS, ""), r"\s+", " "))).alias("body"),
        ),
    )
    # the fold keeps the passages, the last of them still growing
    empty = F.array().cast("array<struct<at:int,level:int,body:string,lines:array<string>>>")
    start = F.struct(empty.alias("done"), F.lit(-1).alias("level"), F.lit(0).alias("at"), F.lit("").alias("body"), F.array().cast("array<string>").alias("lines"))

    def close(a: Column) -> Column:
        one = F.array(F.struct(a["at"].alias("at"), a["level"].alias("level"), a["body"].alias("body"), a["lines"].alias("lines")))
        return F.when(a["body"] == "", a["done"]).otherwise(F.concat(a["done"], one))

    def step(a: Column, x: Column) -> Column:
        same = (a["level"] == x["level"]) & (x["body"] != "") & (a["body"] != "")
        both = F.concat_ws(" ", a["body"], x["body"]).alias("body"), F.concat(a["lines"], F.array(x["body"])).alias("lines")
        return F.when(same, F.struct(a["done"].alias("done"), a["level"].alias("level"), x["at"].alias("at"), *both)).otherwise(
            F.struct(close(a).alias("done"), x["level"].alias("level"), x["at"].alias("at"), x["body"].alias("body"), F.array(x["body"]).alias("lines"))
        )

    return F.aggregate(parsed, start, step, close)


def unquoted(text: Column) -> Column:
    """The text without quoted lines; blank lines left at the ends are cut off."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: ~x.rlike(_MARKS))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s*\n|\n\s*$", "")


def linked(messages: DataFrame) -> DataFrame:
    """messages (conv_id long, turn long, text string) -> (conv_id, turn, n_quotes, parent_conv, parent_turn, by)."""
    n_lines = F.size("p.lines")
    part = lambda at, part, body: F.struct(at.alias("at"), F.lit(part).alias("part"), body.alias("body"))
    lines = F.transform("p.lines", lambda x, k: part(F.col("p.at") - n_lines + 1 + k, 1, x))
    whole = F.array(part(F.col("p.at"), 0, F.col("p.body")))
    cells = stored(
        messages.select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p"))
        .select("conv_id", "turn", "p.level", F.explode(F.when(n_lines > 1, F.concat(whole, lines)).otherwise(whole)).alias("c"))
        .select("conv_id", "turn", "c.at", "level", "c.part", F.sha2("c.body", 256).alias("h"), F.length("c.body").alias("n")),
        "passages",
    )
    asked = cells.where("level > 0")
    counts = asked.where("part = 0").groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))
    written = cells.where("level = 0")
    # only hashes that are quoted matter; a hash is one row on the right, so nothing multiplies
    written = written.join(asked.select("h").distinct(), "h", "left_semi")
    own = written.groupBy("conv_id", "h", "turn").agg(F.max("n").alias("n"))
    both = asked.select("conv_id", "h", "turn", "at", "level", "part", "n").unionByName(own.select("conv_id", "h", "turn"), allowMissingColumns=True)
    before = W.partitionBy("conv_id", "h").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    here = both.withColumn("turn0", F.max(F.when(F.col("at").isNull(), F.col("turn"))).over(before)).where("at is not null")
    # the first to write it, and the first of the other conversations, for quotes in the first one's
    far = own.where(f"n >= {LEAST_CHARS}").groupBy("h", "conv_id").agg(F.min("turn").alias("turn"))
    first = far.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("f"))
    second = far.join(first, "h").where("conv_id <> f.conv_id").groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("f2"))
    found = here.join(first.join(second, "h", "left"), "h", "left").select(
        "conv_id", "turn", "level", "at", "part",
        F.when(F.col("turn0").isNotNull(), F.struct("conv_id", F.col("turn0").alias("turn")))
        .when(F.col("f.conv_id") != F.col("conv_id"), F.col("f")).otherwise(F.col("f2")).alias("to"),
    )
    found = stored(found.where("to is not null"), "quotes")
    rows = stored(answering(messages, found, counts), "links")
    while (bad := ringed(rows)) is not None:
        found = stored(found.join(bad, ["conv_id", "turn", "to"], "left_anti"), "quotes")
        rows = stored(answering(messages, found, counts), "links")
    return rows


def answering(messages: DataFrame, found: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of linked(), by the links found (conv_id, turn, level, at, part, to) and the counts of quotes."""
    best = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("at")).alias("last"), "part", "to")).alias("b"))
    rows = messages.select("conv_id", "turn").distinct()
    order = W.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("previous", F.lag("turn").over(order))
    rows = rows.join(best, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left")
    by_quote = F.col("b").isNotNull()
    return rows.select(
        "conv_id", "turn", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.when(by_quote, F.col("b.to.conv_id")).when(F.col("previous").isNotNull(), F.col("conv_id")).alias("parent_conv"),
        F.when(by_quote, F.col("b.to.turn")).otherwise(F.col("previous")).alias("parent_turn"),
        F.when(by_quote, "quote").when(F.col("previous").isNotNull(), "order").otherwise("start").alias("by"),
    )


def heads_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows of linked(): (conv_id, turn, head, steps), and of heads that quote (k, up, far), the head of
    their parent and how far it is."""
    order = W.partitionBy("conv_id").orderBy("turn")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("no", F.row_number().over(order))
    heads = F.col("by") != "order"
    rows = cut(rows.select(
        "conv_id", "turn", "by", "parent_conv", "parent_turn",
        F.max(F.when(heads, F.col("turn"))).over(so_far).alias("head"), (F.col("no") - F.max(F.when(heads, F.col("no"))).over(so_far)).cast("long").alias("steps"),
    ))
    at = rows.select("conv_id", "turn", F.struct("conv_id", F.col("head").alias("turn")).alias("head"), "steps")
    quoting = rows.where("by = 'quote'").select(F.struct("conv_id", "turn").alias("k"), "parent_conv", "parent_turn")
    parents = at.select(F.col("conv_id").alias("parent_conv"), F.col("turn").alias("parent_turn"), "head", "steps")
    up = F.coalesce("head", F.struct(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn")))
    return at, quoting.join(parents, ["parent_conv", "parent_turn"], "left").select("k", up.alias("up"), (1 + F.coalesce("steps", F.lit(0))).alias("far"))


def ringed(rows: DataFrame) -> DataFrame | None:
    """(conv_id, turn, to): of each ring that the rows of linked() form the link to cut, or None without rings.

    A ring has a link to a larger (conv_id, turn) in another conversation; of those the smallest goes. Heads jump
    by pointer doubling until all have reached a root or gone further than there are heads: the latter are led into
    rings, where they end is on them, and what they passed is the whole ring.
    """
    to = F.struct(F.col("parent_conv").alias("conv_id"), F.col("parent_turn").alias("turn"))
    forward = rows.where("by = 'quote' and parent_conv > conv_id").select(F.struct("conv_id", "turn").alias("k"), to.alias("to"))
    if forward.isEmpty():
        return None
    jumps = heads_of(rows)[1].join(forward, "k", "left")
    jumps = cut(jumps.select("k", "up", F.when(F.col("to").isNotNull(), F.col("k")).alias("low")))
    n, gone = jumps.count(), 1
    while True:
        over = jumps.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        jumps = cut(jumps.join(over, "up").select("k", F.col("up2").alias("up"), F.least("low", "low2").alias("low")))
        gone *= 2
        if jumps.isEmpty():
            return None
        if gone > n:
            break
    on = jumps.select(F.col("up").alias("k")).distinct()
    cuts = jumps.join(on, "k", "left_semi").select(F.col("low").alias("k")).distinct()
    return cut(cuts.join(forward, "k").select("k.conv_id", "k.turn", "to"))


def threads(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, root_conv, root_turn, depth) of the rows of linked().

    A run of messages that answer the one before each has one head, the start or a message that quotes; windows
    give its members their distance to it. Heads that quote then jump along their parents' heads by pointer
    doubling, so a chain of n quotes takes log2(n) rounds, and only unfinished ones take part in a round. Parents
    that aren't there are roots.
    """
    at, jumps = heads_of(rows)
    jumps = cut(jumps.withColumn("done", F.lit(False)))
    while not jumps.where("not done").isEmpty():
        over = jumps.select(F.col("k").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"))
        moved = jumps.where("not done").join(over, "up", "left").select(
            "k", F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.col("up2").isNull().alias("done")
        )
        jumps = cut(jumps.where("done").union(moved))
    got = at.join(jumps.select(F.col("k").alias("head"), "up", "far"), "head", "left")
    root = F.coalesce("up", "head")
    return got.select(
        "conv_id", "turn", root["conv_id"].alias("root_conv"), root["turn"].alias("root_turn"), (F.col("steps") + F.coalesce("far", F.lit(0))).alias("depth")
    )


def conversations(messages: DataFrame) -> DataFrame:
    """messages (conv_id long, turn long, role string, text string, ...) -> a row for each row that has both keys:
    (conv_id, turn, role, content, n_quotes, parent_conv, parent_turn, linked_by, root_conv, root_turn, depth).

    content is the text without quoted lines; a null text is empty. Order by root_conv, root_turn, depth, conv_id and
    turn to read conversations in reply order: every message comes after the one it answers. n_quotes counts
    quoted passages; linked_by is quote, order (answers the turn before) or start. Repeated rows share a place.
    Rows without conv_id or turn are left out. Further columns are ignored. No rows: no rows.
    """
    messages = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    rows = linked(messages)
    placed = rows.join(threads(rows), ["conv_id", "turn"])
    own = messages.select("conv_id", "turn", "role", unquoted(F.col("text")).alias("content"))
    return own.join(placed, ["conv_id", "turn"]).select(
        "conv_id", "turn", "role", "content", "n_quotes", "parent_conv", "parent_turn", F.col("by").alias("linked_by"), "root_conv", "root_turn", "depth"
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations"))

