"""Facts kept as blocks of a Markdown note: blocks, their fields, which section belongs to which fact, and new ones."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut
from ..operators import facts as O
from ..operators.retrieval import small_batches

# A block's heading, a fact's id, the labels of a block's lines.
STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}"
HEAD = rf"## ({STAMP}) · (\w+)[ \t]*"
FACT_ID = rf"{STAMP}(?: #\d+)?"
LABELS = ("Why", "How to apply", "Key", "Valid from", "Valid until", "Replaces", "Supersedes")
_LABEL = rf"\*\*(?:{'|'.join(LABELS)}):\*\*"
_VIA = r"[ \t]*\*via mcp:[^*\n]*\*[ \t]*$"


def numbered(stamp: Column, n: Column) -> Column:
    """A stamp's n-th block's id."""
    return F.when(n > 1, F.concat(stamp, F.lit(" #"), n.cast("string"))).otherwise(stamp)


def blocks(notes: DataFrame) -> DataFrame:
    """(note, ord, id, stamp, category, text) of notes (id, body): a row for each block, in order from 0.

    The id is the stamp; of blocks with one stamp the second and further add " #2" and so on. Text before the first
    block is none's. A null body has no blocks.
    """
    parts = F.filter(F.split(F.regexp_replace("body", "\r\n", "\n"), rf"(?m)^(?={HEAD}$)"), lambda x: x.rlike(rf"^{HEAD}(?:\n|$)"))
    rows = notes.select(F.col("id").alias("note"), F.posexplode(parts).alias("ord", "part"))
    rows = rows.select("note", "ord", F.regexp_extract("part", f"^{HEAD}", 1).alias("stamp"), F.regexp_extract("part", f"^{HEAD}", 2).alias("category"), F.regexp_replace("part", rf"^{HEAD}\n?", "").alias("text"))
    n = F.row_number().over(W.partitionBy("note", "stamp").orderBy("ord"))
    return rows.select("note", "ord", numbered(F.col("stamp"), n).alias("id"), "stamp", "category", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def _label(text: Column, label: str) -> Column:
    """All values of a label: from its line to a blank line, another label or the end."""
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^\*\*{label}:\*\*[ \t]*(.*(?:\n(?!{_LABEL}|{_VIA})[^\n]*\S[^\n]*)*)"), F.lit(1))
    return F.transform(found, lambda x: F.trim(x))


def fields(text: Column) -> dict[str, Column]:
    """fact, why, how, subject, attribute, valid_from, valid_until, replaces and via of a block's text."""
    text = F.regexp_replace(text, "\r\n", "\n")
    last = lambda label: F.nullif(F.try_element_at(_label(text, label), F.lit(-1)), F.lit(""))
    key = last("Key")
    named = F.concat(_label(text, "Replaces"), _label(text, "Supersedes"))
    part = lambda k: F.nullif(F.trim(F.regexp_extract(key, r"(?s)^(.+) / (.*)$", k)), F.lit(""))
    return {
        "fact": F.regexp_replace(F.get(F.split(text, rf"(?m)^(?:{_LABEL}|{_VIA})", 2), F.lit(0)), r"^\s+|\s+$", ""),
        "why": last("Why"), "how": last("How to apply"), "subject": part(1), "attribute": part(2), "valid_from": last("Valid from"), "valid_until": last("Valid until"),
        "replaces": F.array_distinct(F.flatten(F.transform(named, lambda x: F.regexp_extract_all(x, F.lit(FACT_ID), F.lit(0))))),
        "via": F.nullif(F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*\*via (mcp:[^*\n]*)\*[ \t]*$"), F.lit(1)), F.lit(-1))), F.lit("")),
    }


def block_fields(rows: DataFrame) -> DataFrame:
    """Adds the fields() of text to blocks."""
    return rows.select("*", *(c.alias(k) for k, c in fields(F.col("text")).items()))


def section_facts(sections: DataFrame) -> DataFrame:
    """(id, ord, fact): the fact each section window (id, ord, heading, text) of a memory note tells of, by how often
    its stamp began a block so far. Windows that begin no block carry on the block before them."""
    stamp = F.regexp_extract("heading", rf"^({STAMP}) · \w+$", 1)
    rows = sections.withColumn("stamp", F.nullif(stamp, F.lit("")))
    begins = F.col("text").startswith(F.concat(F.lit("## "), "heading")).cast("int")
    n = F.sum(begins).over(W.partitionBy("id", "stamp").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("n", n).select("id", "ord", F.when(F.col("stamp").isNotNull(), numbered(F.col("stamp"), F.greatest("n", F.lit(1)))).alias("fact"))


def rendered(stamp: Column, category: Column, fact: Column, labels: dict[str, Column], via: Column) -> Column:
    """A block as it is written: heading, fact, the labels that have a value, and who told it."""
    lines = [F.concat(F.lit("\n\n**"), F.lit(k), F.lit(":** "), F.nullif(F.trim(v), F.lit(""))) for k, v in labels.items()]
    told = [F.coalesce(x, F.lit("")) for x in lines]
    return F.concat(F.lit("## "), stamp, F.lit(" · "), category, F.lit("\n\n"), F.trim(fact), *told, F.lit("\n\n*via mcp:"), via, F.lit("*\n"))


def remembered(new: DataFrame, current: DataFrame) -> DataFrame:
    """What becomes of new facts (id, category, key, terms, named array<string>, force boolean) beside the current
    ones (id, category, key, terms): (id, verdict, match, replaces).

    It replaces those it names and the current ones of its key. Else it is refused as a duplicate of the most similar
    one, or held where it may change one of its category; force stores it anyway.
    """
    same = new.where("key is not null").select(F.col("id").alias("of"), "key").join(current.select("id", "key"), "key").groupBy("of").agg(F.array_sort(F.collect_set("id")).alias("same"))
    rows = new.join(same, new["id"] == same["of"], "left").select(
        "id", "category", "terms", "force", F.array_union(F.coalesce("named", F.array().cast("array<string>")), F.coalesce("same", F.array().cast("array<string>"))).alias("replaces")
    )
    asked = rows.select("id", "terms", "replaces", "category")
    pairs = cut(_pairs(asked, current))  # read twice
    any_ = _best(pairs).select("id", F.col("match").alias("m0"), F.col("verdict").alias("v0"))
    near = _best(pairs.where("category = old_category")).select("id", F.col("match").alias("m1"), F.col("verdict").alias("v1"))
    rows = rows.join(any_, "id", "left").join(near, "id", "left")
    free = ~F.coalesce(F.col("force"), F.lit(False))
    refused = free & (F.col("v0") == "duplicate")
    held = free & (F.size("replaces") == 0) & (F.col("v1") == "update")
    return rows.select(
        "id", F.when(refused, "duplicate").when(held, "held").otherwise("stored").alias("verdict"),
        F.when(refused, F.col("m0")).when(held, F.col("m1")).alias("match"), F.when(refused | held, F.array().cast("array<string>")).otherwise(F.col("replaces")).alias("replaces"),
    )


#: Facts of a chunk of current facts and of a block of new ones, and terms of either, at most.
CHUNK, BLOCK, TERMS = 16_384, 2048, 4_000_000
#: New facts of a block that are counted at once. Terms that one of COMMON facts of a chunk has are multiplied as a matrix,
#: SLICE of them at most; of others the facts that have them are added up, together where they are few.
GROUP, COMMON, SLICE, FEW = 64, 10, 1024, 96


def _together(most: int, pack):
    """Facts in tables of at most `most` of them and about TERMS terms, each made a row by pack()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, facts, terms = [], 0, 0
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("terms")))  # here, as a filter of Spark's would make the terms twice
            ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                before = ends[lo - 1] if lo else 0
                n = min(int(np.searchsorted(ends[lo:] - before, TERMS - terms, "right")), most - facts)
                if n < 1 and held:
                    yield pack(pa.Table.from_batches(held))
                    held, facts, terms = [], 0, 0
                    continue
                part = batch.slice(lo, max(1, n))
                lo += part.num_rows
                held.append(part)
                facts, terms = facts + part.num_rows, terms + int(ends[lo - 1] - before)
        if held:
            yield pack(pa.Table.from_batches(held))

    return run


def _row(**values: pa.Array | bytes) -> pa.RecordBatch:
    """One row: arrays as lists, bytes as they are."""
    one = lambda x: pa.array([x], pa.binary()) if isinstance(x, bytes) else pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    return pa.RecordBatch.from_arrays([one(x) for x in values.values()], list(values))


def _packed(words: pa.StringArray) -> tuple[bytes, bytes]:
    """Where each word begins, and all words end to end: strings that Spark need not take apart."""
    begins = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy())]).astype(np.int32)
    return begins.tobytes(), (pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer().to_pybytes() if len(words) else b"")


def _words(begins: pa.Buffer, text: pa.Buffer) -> pa.StringArray:
    return pa.StringArray.from_buffers(begins.size // 4 - 1, begins, text)


def _numbered(facts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """How many terms each fact has; of each term that isn't null its fact and its number in the words; the words."""
    lists = facts.column("terms").combine_chunks()
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    flat = lists.flatten()
    of = np.repeat(np.arange(len(sizes)), sizes)[pc.is_valid(flat).to_numpy(zero_copy_only=False)]
    coded = flat.drop_null().dictionary_encode()
    return sizes, of, coded.indices.to_numpy(), coded.dictionary


def _chunk(facts: pa.Table) -> pa.RecordBatch:
    """Current facts by category and id, and of each of their words the facts that have it."""
    facts = facts.take(pc.sort_indices(facts, [("old_category", "ascending"), ("old", "ascending")]))
    sizes, of, codes, words = _numbered(facts)
    places = of[np.argsort(codes, kind="stable")].astype(np.uint16)
    ends = np.cumsum(np.bincount(codes, minlength=len(words)))
    old, kind = (facts.column(c).combine_chunks() for c in ("old", "old_category"))
    begins, text = _packed(words)
    return _row(old=old, old_category=kind, sizes=pa.array(sizes, pa.int32()), begins=begins, words=text, ends=ends.astype(np.int32).tobytes(), places=places.tobytes())


def _block(facts: pa.Table) -> pa.RecordBatch:
    """New facts, and the words of each one after the other."""
    sizes, of, codes, words = _numbered(facts)
    ids, kind, replaces = (facts.column(c).combine_chunks() for c in ("id", "category", "replaces"))
    begins, text = _packed(words)
    own = np.bincount(of, minlength=len(sizes))
    return _row(id=ids, category=kind, replaces=replaces, asked_sizes=pa.array(sizes, pa.int32()), asked_begins=begins, asked=text, own=pa.array(own, pa.int32()), codes=codes.astype(np.int32).tobytes())


def _shared(own: np.ndarray, codes: np.ndarray, ends: np.ndarray, places: np.ndarray, n_old: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first, counts): how many terms each of some new facts, from the first on, has in common with each of n_old current
    ones. New facts have `own` terms each, codes are these terms' words or -1; a word's facts are places up to its end."""
    begins = np.concatenate([[0], ends[:-1]])
    df = ends - begins
    often = np.argsort(-df, kind="stable")[:SLICE]
    often = often[df[often] * COMMON >= n_old]
    column = np.full(len(ends) + 1, -1)  # the last is that of -1
    column[often] = np.arange(len(often))
    held = np.zeros((len(often), n_old), np.float32)
    for k, word in enumerate(often):
        held[k] = np.bincount(places[begins[word] : ends[word]], minlength=n_old)
    stops = np.concatenate([[0], np.cumsum(own)])
    for lo in range(0, len(own), GROUP):
        hi = min(lo + GROUP, len(own))
        words = codes[stops[lo] : stops[hi]]
        new = np.repeat(np.arange(hi - lo), own[lo:hi])
        at = column[words]
        asked = np.bincount(new[at >= 0] * len(often) + at[at >= 0], minlength=(hi - lo) * len(often)).reshape(hi - lo, len(often))
        both = asked.astype(np.float32) @ held
        size = np.where((at < 0) & (words >= 0), df[words], 0)
        few = (size > 0) & (size < FEW)
        n = size[few]
        at = np.repeat(begins[words[few]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(both.reshape(-1), np.repeat(new[few] * n_old, n) + places[at], np.float32(1))
        words, new = words[size >= FEW], new[size >= FEW]
        first, last = begins[words].tolist(), ends[words].tolist()
        cuts = np.searchsorted(new, np.arange(hi - lo + 1)).tolist()
        for k in range(hi - lo):
            if cuts[k] < cuts[k + 1]:
                both[k] += np.bincount(np.concatenate([places[i:j] for i, j in zip(first[cuts[k] : cuts[k + 1]], last[cuts[k] : cuts[k + 1]])]), minlength=n_old)
        yield lo, both


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk and block (a row) the most similar fact of each new one, and the most similar of its category."""
    for batch in batches:
        for r in range(batch.num_rows):
            get = lambda c: batch.column(c)[r].values  # noqa: B023, E731
            old, old_kind, ids, kind = get("old"), get("old_category"), get("id").to_pylist(), get("category").to_pylist()
            n, m = get("asked_sizes").to_numpy().astype(np.int64), get("sizes").to_numpy().astype(np.int64)
            raw = lambda c: batch.column(c)[r].as_buffer()  # noqa: B023, E731
            place = pc.fill_null(pc.index_in(_words(raw("asked_begins"), raw("asked")), value_set=_words(raw("begins"), raw("words"))), -1).to_numpy(zero_copy_only=False)
            codes, ends = np.frombuffer(raw("codes"), np.int32), np.frombuffer(raw("ends"), np.int32).astype(np.int64)
            places = np.frombuffer(raw("places"), np.uint16).astype(np.int64)
            named = get("replaces")
            replaced = named.to_pylist() if len(named.flatten()) else [()] * len(ids)
            where = {k: i for i, k in enumerate(old.to_pylist())} if len(named.flatten()) else {}
            # facts of a category stand side by side
            of_kind = old_kind.dictionary_encode(null_encoding="encode")
            numbers = of_kind.indices.to_numpy()
            starts = np.flatnonzero(np.diff(numbers, prepend=-1))
            stops = np.append(starts[1:], len(m))
            part = {x: k for k, x in enumerate(of_kind.dictionary.to_pylist())}
            found = []
            for lo, both in _shared(get("own").to_numpy(), place[codes] if len(place) else codes, ends, places, len(m)):
                mine = n[lo : lo + len(both), None].astype(np.float32)
                least = np.maximum(np.minimum(m.astype(np.float32), mine), 1) / np.float32(O.CONTAINMENT_SHARE)
                score = both / np.maximum(np.minimum(m.astype(np.float32) + mine - both, least), np.float32(0.5))
                for k, gone in enumerate(replaced[lo : lo + len(both)]):
                    for name in gone or ():
                        if name in where:
                            score[k, where[name]] = -1.0
                tops = np.maximum.reduceat(score, starts, axis=1)
                for k, top in enumerate(tops):
                    own_kind = part.get(kind[lo + k]) if kind[lo + k] is not None else None
                    looked = [(0, len(m), top.max())] + ([(starts[own_kind], stops[own_kind], top[own_kind])] if own_kind is not None else [])
                    best = set()
                    for i, j, s in looked:
                        if s > 0:
                            at = i + np.flatnonzero(score[k, i:j] >= s * np.float32(1 - 1e-5))
                            b = both[k, at].astype(np.float64)
                            exact = np.maximum(b / (m[at] + n[lo + k] - b), O.CONTAINMENT_SHARE * (b / np.minimum(m[at], n[lo + k])))
                            at = at[exact == exact.max()]
                            best.add(int(at[0] if len(starts) == 1 or j - i < len(m) else min(at, key=lambda z: old[int(z)].as_py())))
                    found += [(lo + k, i, float(both[k, i])) for i in best]
            a, i, b = (np.array(z) for z in (zip(*found) if found else ([], [], [])))
            a, i = a.astype(np.int64), i.astype(np.int64)
            j, c = b / (m[i] + n[a] - b), b / np.minimum(m[i], n[a])
            yield pa.RecordBatch.from_arrays([get("id").take(pa.array(a)), get("category").take(pa.array(a)), old.take(pa.array(i)), old_kind.take(pa.array(i)), pa.array(j, pa.float64()), pa.array(c, pa.float64())], ["id", "category", "old", "old_category", "j", "c"])


def _pairs(new: DataFrame, current: DataFrame) -> DataFrame:
    """(id, category, old, old_category, j, c) of new facts and those they share a term with and don't replace: of each
    chunk of current facts the best for a new one, and the best of its category.

    A chunk of current facts is shuffled once with the places of its words, and meets blocks of new facts. Common terms are
    counted by a product of matrices, others by going through the facts that have them; scores in single precision find
    the few facts that can be the best, which are then compared exactly. What a task holds is bounded; the work is still
    that of all pairs.
    """
    small_batches(new.sparkSession)
    kinds = dict(new.dtypes) | {"old": dict(current.dtypes)["id"]}
    y = current.select(F.col("id").alias("old"), F.col("category").alias("old_category"), "terms")
    y = y.mapInArrow(_together(CHUNK, _chunk), f"old array<{kinds['old']}>, old_category array<string>, sizes array<int>, begins binary, words binary, ends binary, places binary")
    # few new facts of each part of the input make full blocks
    x = new.select("id", "category", "replaces", "terms").repartition(max(1, -(-new.count() // BLOCK)))
    x = cut(x.mapInArrow(_together(BLOCK, _block), f"id array<{kinds['id']}>, category array<string>, replaces array<array<string>>, asked_sizes array<int>, asked_begins binary, asked binary, own array<int>, codes binary"))
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = y.repartition(parts).join(x.hint("shuffle_replicate_nl"))
    return met.mapInArrow(_nearest, f"id {kinds['id']}, category string, old {kinds['old']}, old_category string, j double, c double")


def _best(pairs: DataFrame) -> DataFrame:
    score = F.greatest("j", O.CONTAINMENT_SHARE * F.col("c"))
    best = pairs.groupBy("id").agg(F.min_by(F.struct("old", "j", "c"), F.struct(-score, F.col("old"))).alias("b"))
    verdict = F.when((F.col("b.j") >= O.DUPLICATE_JACCARD) | (F.col("b.c") >= O.DUPLICATE_CONTAINMENT), "duplicate").when(F.col("b.j") >= O.UPDATE_JACCARD, "update").otherwise("new")
    return best.select("id", F.col("b.old").alias("match"), verdict.alias("verdict"))
