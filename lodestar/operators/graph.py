"""The link graph: weights, pairs, strengths, neighbours and what search does with them."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut
from .retrieval import TASK_ROWS, small_batches, told

# Weight of a link by its kind, and of frontmatter links by their key.
KIND_WEIGHTS = {"sentence": 1.0, "embed": 0.8, "list_explained": 0.7, "heading": 0.5, "table": 0.5, "short": 0.4, "list_bare": 0.3, "trailer": 0.0}
KEY_WEIGHTS = {"related": 0.3, "part-of": 0.3, "project": 0.2, "topics": 0.15, "*": 0.2}
STRUCTURAL = ("hub", "concept", "moc", "meta", "guide")


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def weighted(edges: DataFrame) -> DataFrame:
    """Adds weight to link occurrences (kind, fm_key)."""
    by_key = F.coalesce(F.try_element_at(_map(KEY_WEIGHTS), F.col("fm_key")), F.lit(KEY_WEIGHTS["*"]))
    by_kind = F.coalesce(F.try_element_at(_map(KIND_WEIGHTS), F.col("kind")), F.lit(0.0))
    return edges.withColumn("weight", F.when(F.col("kind") == "fm", by_key).otherwise(by_kind))


def parts_of(spark: SparkSession, rows: int) -> int:
    """Tasks that so many links are dealt to: what one of them holds doesn't grow with the links."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _dealt(rows: DataFrame, parts: int | None, *by: str) -> DataFrame:
    return rows.repartition(parts, *by) if parts else rows


def pairs(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(a, b, base, kind, bodies, n) of weighted occurrences (a, b, pos, kind, weight): base is the largest weight,
    kind that of the first with it, bodies those in running text. Unresolved ends and self-links go. Links of large tables
    are dealt to `parts` tasks."""
    body = ~F.col("kind").isin("fm", "trailer")
    return _dealt(edges.where("b is not null and a <> b"), parts, "a", "b").groupBy("a", "b").agg(
        F.max("weight").alias("base"), F.min_by("kind", F.struct(-F.col("weight"), F.col("pos"))).alias("kind"),
        F.count_if(body).alias("bodies"), F.count("*").alias("n"),
    )


def degrees(pairs: DataFrame, least: float = 0.15) -> DataFrame:
    """(id, in_degree, out_degree) over pairs that count."""
    strong = pairs.where(F.col("base") >= least)
    ends = strong.select(F.col("b").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(strong.select("a", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def specificity(degree: Column) -> Column:
    return F.lit(1.584962500721156) / F.log2(2 + F.greatest(F.lit(1), F.coalesce(degree, F.lit(1))))


def strengths(pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds out_strength (seen from a) and in_strength (seen from b): base, raised by repeats and by a link back,
    lowered by the degree of the far end. Both directions of a pair meet in one shuffle; degrees go to all tasks where
    they are few. Pairs of large tables are dealt to `parts` tasks."""
    deg = cut(degrees(pairs))
    rows = _dealt(pairs.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")), parts, "x", "y")
    rows = rows.withColumn("told", F.sum((F.col("bodies") > 0).cast("int")).over(W.partitionBy("x", "y")))  # 2: both in running text
    few = told(deg)
    for end, name in (("b", "in_degree"), ("a", "out_degree")):
        rows = (rows if few is not deg else _dealt(rows, parts, end)).join(few.select(F.col("id").alias(end), name), end, "left")
    repeats = F.when(F.col("bodies") > 0, 1 + 0.25 * (F.least(F.col("bodies"), F.lit(3)) - 1)).otherwise(1.0)
    mutual = F.when((F.col("told") == 2) & (F.col("bodies") > 0) & (F.col("base") >= 0.3), 1.2).otherwise(1.0)
    own = F.col("base") * repeats * mutual
    return rows.select(
        *pairs.columns, (own * specificity(F.col("in_degree"))).alias("out_strength"), (0.8 * own * specificity(F.col("out_degree"))).alias("in_strength")
    )


def neighbours(strong: DataFrame) -> DataFrame:
    """(id, nb, strength, dir, rank): of both directions the stronger (out on a tie), strongest first."""
    both = strong.select(F.col("a").alias("id"), F.col("b").alias("nb"), F.col("out_strength").alias("strength"), F.lit("out").alias("dir")).union(
        strong.select("b", "a", "in_strength", F.lit("in"))
    )
    best = both.groupBy("id", "nb").agg(F.max(F.struct(F.round("strength", 9).alias("s"), "dir")).alias("m")).select("id", "nb", F.col("m.s").alias("strength"), F.col("m.dir").alias("dir"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("strength"), "nb")))


#: Notes of a topic that go to a note in one row.
TOGETHER = 256


def _met(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(note, nb, n, topics) of whole notes' rows (note, said, behind), in order of their topics."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    behind = rows.column("behind").combine_chunks()
    at = pa.array(np.repeat(np.arange(len(behind)), behind.value_lengths().to_numpy()))
    pairs = pa.table({"note": rows.column("note").take(at), "nb": behind.flatten(), "said": rows.column("said").take(at)})
    met = pairs.group_by(["note", "nb"], use_threads=False).aggregate([("said", "list"), ("said", "count")]).combine_chunks()
    topics = pc.binary_join(met.column("said_list"), "|")
    return pa.RecordBatch.from_arrays([x.combine_chunks() for x in (met.column("note"), met.column("nb"), met.column("said_count"), topics)], ["note", "nb", "n", "topics"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their notes: those of a note are met at once, and no more of them held."""
    held = []
    for batch in batches:
        notes = batch.column("note")
        last = notes[len(notes) - 1]
        first = pc.index(pc.equal(notes, last), True).as_py()
        if held and (first or held[-1].column("note")[0] != last):
            held, done = [], [*held, batch.slice(0, first)]
            yield _met([x for x in done if x.num_rows])
        elif first:
            yield _met([batch.slice(0, first)])
        held.append(batch.slice(first))
    if held:
        yield _met(held)


def sharing(topics: DataFrame) -> DataFrame:
    """(id, nb, n, topics): notes (note, topic) that share topics, how many and which, joined by |; in both directions.

    A topic's notes are packed into short sorted lists, and each of its notes gets the part of them behind itself. So
    lists are shuffled and sorted, not pairs; each pair is put together once, at its smaller note, when that note's lists
    are there, and turned round afterwards.
    """
    small_batches(topics.sparkSession)
    t = topics.where("note is not null and topic is not null").distinct()
    place = F.row_number().over(W.partitionBy("topic").orderBy("note"))
    lists = t.withColumn("part", F.floor((place - 1) / TOGETHER)).groupBy("topic", "part").agg(F.array_sort(F.collect_list("note")).alias("others"))
    behind = F.filter("others", lambda x: x > F.col("note"))
    parts = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = t.join(lists.select("topic", "others", F.element_at("others", -1).alias("last")), "topic").where("last > note")
    rows = rows.select("note", "topic", behind.alias("behind")).repartition(parts, "note")
    rows = rows.sortWithinPartitions("note", "topic").select("note", F.col("topic").cast("string").alias("said"), "behind")
    kind = dict(t.dtypes)["note"]
    told = rows.mapInArrow(_together, f"note {kind}, nb {kind}, n long, topics string")
    ends = F.array(F.struct(F.col("note").alias("id"), "nb"), F.struct(F.col("nb").alias("id"), F.col("note").alias("nb")))
    return told.select(F.inline(ends), "n", "topics").select("id", "nb", "n", "topics")


def fair_swap(head: DataFrame, picks: DataFrame, protected: DataFrame, top: int = 3) -> DataFrame:
    """(query_id, out, into): the i-th pick replaces the i-th weakest unprotected entry below the first `top`, until one
    isn't strictly better. head (query_id, key, rank, fit), picks (query_id, key, fit), protected (query_id, key)."""
    weak = head.where(F.col("rank") > top).join(protected, ["query_id", "key"], "left_anti")
    weak = weak.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy("fit", F.desc("rank"))))
    strong = picks.withColumn("i", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("fit"), "key")))
    rows = weak.select("query_id", "i", F.col("key").alias("out"), F.col("fit").alias("low")).join(
        strong.select("query_id", "i", F.col("key").alias("into"), F.col("fit").alias("high")), ["query_id", "i"]
    )
    good = F.min((F.col("high") > F.col("low")).cast("int")).over(W.partitionBy("query_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("good", good).where("good = 1").select("query_id", "out", "into")


def glow(strong: DataFrame, start: DataFrame, decay: tuple[float, ...] = (0.95, 0.74, 0.79), parts: int | None = None) -> DataFrame:
    """(id, hop, light): the strongest path from start (id) within as many hops as there are decays. A pair's bond is kept
    once, whichever way it is gone; rings go to all tasks where they are few notes."""
    bond = 0.35 + 0.65 * F.least(F.lit(1.0), F.greatest("out_strength", "in_strength") / 0.6)
    bonds = _dealt(strong.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), bond.alias("bond")), parts, "x", "y")
    bonds = cut(bonds.groupBy("x", "y").agg(F.max("bond").alias("bond")))
    edges = bonds.union(bonds.select("y", "x", "bond"))
    seen = start.select("id", F.lit(0).alias("hop"), F.lit(1.0).alias("light"))
    ring = seen
    for k, fade in enumerate(decay, 1):
        few = told(ring)
        ring = (edges if few is not ring else _dealt(edges, parts, "x")).join(few.select(F.col("id").alias("x"), "light"), "x")
        ring = ring.groupBy(F.col("y").alias("id")).agg(F.max(F.round(F.col("light") * F.col("bond") * fade, 9)).alias("light"))
        ring = cut(ring.join(seen.select("id"), "id", "left_anti").select("id", F.lit(k).alias("hop"), "light"))
        seen = seen.union(ring)
    return seen


PREFIX_CHARS = 200


def linking_sentences(picks: DataFrame, occurrences: DataFrame, windows: DataFrame) -> DataFrame:
    """(query_id, note, prefix): what to say in front of a section that came by a link.

    picks (query_id, note, ord, seed, seed_title, dir), occurrences (a, b, pos, ord, weight, ctx), windows (query_id,
    note, ord, cos, heading). Of the linking note's occurrences the one in the window closest to the question counts,
    then the heaviest, then the first. None where the section of a note that links in shows the link itself, or where
    only frontmatter links.
    """
    out = F.col("dir") == "out"
    rows = picks.withColumn("a", F.when(out, F.col("seed")).otherwise(F.col("note"))).withColumn("b", F.when(out, F.col("note")).otherwise(F.col("seed")))
    rows = rows.join(occurrences.where("ord is not null").withColumnRenamed("ord", "at"), ["a", "b"])
    near = windows.select("query_id", F.col("note").alias("a"), F.col("ord").alias("at"), "cos", "heading")
    rows = rows.join(near, ["query_id", "a", "at"], "left")
    shown = F.max((~out) & (F.col("at") == F.col("ord"))).over(W.partitionBy("query_id", "note"))
    best = W.partitionBy("query_id", "note").orderBy(F.desc_nulls_last("cos"), F.desc("weight"), "pos")
    rows = rows.withColumn("shown", shown).withColumn("k", F.row_number().over(best)).where("k = 1 and not shown and ctx is not null and ctx <> ''")
    text = F.when(F.length("ctx") > PREFIX_CHARS, F.concat(F.rtrim(F.left("ctx", F.lit(PREFIX_CHARS - 1))), F.lit("…"))).otherwise(F.col("ctx"))
    other = F.when(F.col("heading").isNotNull() & (F.lower("heading") != F.lower("seed_title")), F.concat(F.lit(" / "), "heading")).otherwise(F.lit(""))
    prefix = F.when(out, F.concat(F.lit("Linked from "), "seed_title", other, F.lit(": "), text)).otherwise(F.concat(F.lit("Links to "), "seed_title", F.lit(": "), text))
    return rows.select("query_id", "note", prefix.alias("prefix"))


# The limits of the graph's settings, and what holds where one isn't a number.
LIMITS = {
    "slots": (0, 64, 10), "seeds": (1, 16, 5), "linksPerSeed": (1, 10, 3), "minWeight": (0, 10, 0.2), "swapWeight": (0, 1000, 1), "keepLinked": (0, 5, 1), "keepMinWeight": (0.01, 10, 0.1),
}


def settings(given: dict | bool | None) -> dict:
    """Settings of the graph within their limits."""
    given = {"enabled": given} if isinstance(given, bool) else given or {}
    number = lambda k, else_: given[k] if isinstance(given.get(k), (int, float)) and not isinstance(given.get(k), bool) and given[k] == given[k] else else_
    out = {k: min(hi, max(lo, number(k, else_))) for k, (lo, hi, else_) in LIMITS.items()}
    whole = ("slots", "seeds", "linksPerSeed", "keepLinked")
    return {k: round(v) if k in whole else v for k, v in out.items()} | {"enabled": given.get("enabled") in (True, 1, "true"), "prefix": given.get("prefix") is not False}


def meaning(vectors: DataFrame, parts: int = 3, rounds: int = 100) -> DataFrame:
    """(note, sem array<double>) of vectors (note, v): the mean vector of each note, of length one, on the principal
    components of all, each scaled to at most 1 and rounded to 3 digits. Fewer than 4 notes have none.

    The components come from the notes' d x d scatter matrix, which tasks sum up; only that matrix, whose size is the
    vectors' and not the table's, reaches the driver. Power iteration starts from sines, which fixes the signs.
    """
    import numpy as np

    rows = vectors.select("note", F.posexplode("v").alias("i", "x")).groupBy("note", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = rows.groupBy("note").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    unit = mean.select("note", F.when(norm > 0, F.transform("m", lambda x: x / norm)).otherwise(F.col("m")).alias("m"))

    def scatter(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("m").to_pylist())
                one = np.vstack([np.hstack([x.T @ x, x.sum(0)[:, None]]), np.full(x.shape[1] + 1, float(len(x)))])
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["k", "x"])

    cells = {r.k: r.x for r in unit.select("m").mapInArrow(scatter, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()}
    d = int(((1 + 4 * len(cells)) ** 0.5 - 1) / 2)
    n = cells.get(len(cells) - 1, 0)
    if n < 4:
        return unit.select("note", F.array().cast("array<double>").alias("sem")).limit(0)
    table = np.array([cells[k] for k in range(len(cells))]).reshape(d + 1, d + 1)
    centre = table[:d, d] / n
    spread = table[:d, :d] - n * np.outer(centre, centre)
    found: list = []
    for c in range(parts):
        w = np.sin(np.arange(d) * (c + 1) + 1)
        for _ in range(rounds):
            w = spread @ w
            for u in found:
                w = w - (w @ u) * u
            w = w / (np.linalg.norm(w) or 1)
        found.append(w)
    axes = [F.array(*(F.lit(float(x)) for x in u)) for u in found]
    on = [F.aggregate(F.zip_with("m", a, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) - float(centre @ u) for a, u in zip(axes, found)]
    placed = unit.select("note", *(c.alias(f"p{k}") for k, c in enumerate(on)))
    most = placed.agg(*(F.max(F.abs(f"p{k}")).alias(f"s{k}") for k in range(parts)))  # one row
    scaled = [F.round(F.col(f"p{k}") / F.when(F.col(f"s{k}") > 0, F.col(f"s{k}")).otherwise(1.0), 3) for k in range(parts)]
    return placed.crossJoin(F.broadcast(most)).select("note", F.array(*scaled).alias("sem"))


def colour(sem: Column, muted: Column) -> Column:
    """struct<hue, saturation, lightness> of a note's place: the first two components give the hue, the third the
    lightness; notes without a place are grey."""
    x, y, z = (F.get(sem, F.lit(k)) for k in range(3))
    hue = F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))
    strength = F.least(F.lit(1.0), F.hypot(x, y))
    grey = F.struct(F.lit(225.0).alias("hue"), F.lit(6.0).alias("saturation"), F.lit(62.0).alias("lightness"))
    own = F.struct(hue.alias("hue"), ((30 + 40 * strength) * F.when(muted, 0.3).otherwise(1.0)).alias("saturation"), (60 + 8 * z).alias("lightness"))
    return F.when(sem.isNull() | (F.size(sem) < 3), grey).otherwise(own)


def project_places(places: DataFrame) -> DataFrame:
    """(project, sem) of places (project, sem): the mean place of a project's notes, drawn out by 1.6."""
    mean = [(F.avg(F.get("sem", F.lit(k))) * 1.6).alias(f"m{k}") for k in range(3)]
    return places.where("project is not null and sem is not null").groupBy("project").agg(*mean).select("project", F.array("m0", "m1", "m2").alias("sem"))


def node_size(degree: Column) -> Column:
    return 2 + 1.2 * F.pow(degree, 0.8)


def visible(links: DataFrame, nodes: DataFrame, least: float = 0.15, hubs: bool = True) -> DataFrame:
    """Links (x, y, strength) that are drawn: strong enough, and where hubs are hidden between notes that aren't
    structural. nodes (id, structural)."""
    shown = nodes if hubs else nodes.where("not structural")
    rows = links.where(F.col("strength") >= least)
    for end in ("x", "y"):
        rows = rows.join(shown.select(F.col("id").alias(end)), end, "left_semi")
    return rows.select(*links.columns)
