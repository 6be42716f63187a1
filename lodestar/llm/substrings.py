"""Substring deduplication by level-wise doubling: 5, 10, then 20 words.

A window of 20 words can repeat only if its parts do, so windows are counted at 5 words first, and only what
repeats is extended to twice the length.

Level 5. Of the sixteen 5-word windows inside a 20-word window the one with the smallest hash (the leftmost, on
ties) is its anchor; equal windows have equal anchors at equal offsets. Counting the anchors alone, about one
word in eight, therefore loses no repeat. The 20-word windows that share one anchor are consecutive and form a
segment, the unit of what follows. Segments whose anchor occurs once are done.
Level 10. Equal segments form a class; all members but the earliest are covered whole. Classes with equal
anchors and unequal words go on only if the 10 words right or left of the anchor are shared too.
Level 20. The earliest segment of each class that is left is spelled out in 20-word windows; of equal windows
the earliest stays.

Groups of copies collapse to one row a class by partial aggregation. Keys of windows and classes are 128 bits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .words import U64, WHITE, Words, _powers_to, combine, double, five, mix, parts, signed

WINDOW = 20
_SPAN = WINDOW - 5 + 1
#: Low bits of an anchor's key that hold its place, which makes the leftmost win a tie.
_PLACE = 24


def _anchor_places(h5: np.ndarray) -> np.ndarray:
    """For each start the place of the smallest of the next 16 hashes, the leftmost on ties."""
    step = (1 << _PLACE) - _SPAN
    if len(h5) > step + _SPAN:
        ranges = range(0, len(h5) - _SPAN + 1, step)
        return np.concatenate([_anchor_places(h5[k : k + step + _SPAN - 1]) + k for k in ranges])
    key = ((h5 >> U64(_PLACE)) << U64(_PLACE)) | (np.arange(len(h5), dtype=U64) & U64((1 << _PLACE) - 1))
    for k in (1, 2, 4, 8):
        key = np.minimum(key[:-k], key[k:])
    return (key & U64((1 << _PLACE) - 1)).astype(np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h5, seg, doc_id, cell): cell packs the first start (31 bits), the number of starts (5), and 14 bits
    each of the hashes of the 10 words right and left of the anchor, 0 where no window of the segment holds them."""
    for batch in parts(batches):
        w = Words(batch.column("text"), WHITE)
        h = w.hashes()
        if len(h) < WINDOW:
            continue
        h5 = five(h)
        h10 = combine(h5[:-5], h5[5:])
        size = np.diff(w.ptr)
        row = np.repeat(np.arange(len(size)), size)
        starts = np.flatnonzero(np.arange(len(h)) + WINDOW <= w.ptr[1:][row])
        if not len(starts):
            continue
        at = _anchor_places(h5)[starts]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1])])  # anchors of two rows are never at one place
        lo, p = starts[first], at[first]
        n = np.diff(np.r_[first, len(starts)])
        end = lo + n + WINDOW - 1
        power, inverse = _powers_to(len(h) + 1)
        sums = np.zeros(len(h) + 1, dtype=U64)
        np.cumsum(h * power[: len(h)], out=sums[1:])
        seg = mix((sums[end] - sums[lo]) * inverse[lo] + ((p - lo) * 32 + n).astype(U64))
        far = p - lo  # the largest offset of the anchor in a window; the least is far - n + 1
        bits = lambda x: (x >> U64(50)).astype(np.int64) | 1
        right = np.where(far - n + 1 <= WINDOW - 10, bits(h10[np.minimum(p, len(h10) - 1)]), 0)
        left = np.where(far >= 5, bits(h10[np.maximum(p - 5, 0)]), 0)
        r = row[lo]
        cell = ((lo - w.ptr[r]) << 33) | (n << 28) | (right << 14) | left
        ids = batch.column("doc_id").take(pa.array(r))
        yield pa.RecordBatch.from_arrays([signed(h5[p]), signed(seg), ids, pa.array(cell)], ["h5", "seg", "doc_id", "cell"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 20-word windows of the listed segments of each text."""
    for batch in parts(batches):
        w = Words(batch.column("text"), WHITE)
        h = w.hashes()
        if len(h) < WINDOW:
            continue
        h5 = five(h)
        h20 = double(combine(h5[:-5], h5[5:]), 10)
        cells = batch.column("cells")
        row = np.repeat(np.arange(len(cells)), np.asarray(cells.value_lengths().fill_null(0)))
        cell = np.asarray(cells.flatten(), dtype=np.int64)
        n = (cell >> 28) & 31
        start = np.repeat(cell >> 33, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(row, n)
        at = start + w.ptr[row]
        ids = batch.column("doc_id").take(pa.array(row))
        yield pa.RecordBatch.from_arrays([signed(h20[at]), signed(h5[at]), ids, pa.array(start)], ["h20", "h5", "doc_id", "start"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        n_words, n_removed, kept = [], [], []
        for text, cells in zip(batch.column("text"), batch.column("cells")):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            if cells.is_valid and len(cells.values):
                cell = np.asarray(cells.values)
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, cell >> 33, 1)
                np.add.at(change, (cell >> 33) + ((cell >> 28) & 31) + WINDOW - 1, -1)
                stays = np.cumsum(change[:-1]) == 0
                left = [words[k] for k in np.flatnonzero(stays).tolist()]
            else:
                left = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            [*batch.schema.names[:-1], "n_words", "n_removed", "kept"],
        )


def without_repeats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, text, the columns keep, n_words long, n_removed long, kept
    string), a row for each row.

    Words are runs of other than space and \\t..\\r, unchanged; a null text has none. Every word is removed that a
    20-word window covers whose words also start earlier: in a smaller doc_id, or earlier in the same document.
    kept is the words left, joined by one space; nothing is cut at line ends. Rows with one doc_id are one
    document and must be equal; they are judged alike, each keeping what the first keeps. Rows without doc_id
    come last in no order, so they neither lose words nor take them from others. Columns beside keep are ignored.
    """
    docs = docs.select("doc_id", "text", *keep)
    placed = docs.where("doc_id is not null")
    found = placed.select("doc_id", "text").mapInArrow(_segments, "h5 long, seg long, doc_id long, cell long").repartition("h5")
    # repeated: not all rows are one place. All columns are used, so that one exchange serves this and the join
    ends = [f(c).alias(f"{c}{k}") for c in ("doc_id", "cell", "seg") for k, f in enumerate((F.min, F.max))]
    again = found.groupBy("h5").agg(*ends).where("doc_id0 < doc_id1 or cell0 < cell1 or seg0 < seg1").select("h5")
    live = stored(found.join(again.hint("shuffle_hash"), "h5"), "segments")

    classes = stored(
        live.groupBy("h5", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "cell")).alias("first")), "classes"
    )
    many = classes.where("n > 1").select("h5", "seg", F.col("first.doc_id").alias("d0"), F.col("first.cell").alias("c0"))
    later = live.join(many, ["h5", "seg"]).where("doc_id <> d0 or cell <> c0").select("doc_id", "cell")

    ten = classes.selectExpr("h5", "first", "cast(shiftright(first.cell, 14) & 16383 as int) as r", "cast(first.cell & 16383 as int) as l")
    side = lambda x: ten.where(f"{x} <> 0").groupBy("h5", x).agg(F.count("*").alias(f"n{x}")).where(f"n{x} > 1")
    ten = ten.join(side("r"), ["h5", "r"], "left").join(side("l"), ["h5", "l"], "left").where("nr is not null or nl is not null")
    # equal rows give equal cells, and so the same windows; a set keeps them once
    spell = ten.groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_set("first.cell").alias("cells"))

    texts = placed.repartition("doc_id")
    windows = texts.join(spell, "doc_id").select("doc_id", "text", "cells").mapInArrow(_windows, "h20 long, h5 long, doc_id long, start long").repartition("h20")
    earliest = (
        windows.groupBy("h20", "h5")
        .agg(F.min(F.struct("doc_id", "start")).alias("f"), F.max(F.struct("doc_id", "start")).alias("g"))
        .where("f <> g")
        .select("h20", "h5", F.col("f.doc_id").alias("d0"), F.col("f.start").alias("s0"))
    )
    single = windows.join(earliest.hint("shuffle_hash"), ["h20", "h5"]).where("doc_id <> d0 or start <> s0")
    gone = later.union(single.selectExpr("doc_id", f"shiftleft(start, 33) | {1 << 28}L as cell"))
    cells = gone.groupBy("doc_id").agg(F.collect_list("cell").alias("cells"))
    out = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + "n_words long, n_removed long, kept string"
    placeless = docs.where("doc_id is null").withColumn("cells", F.lit(None).cast("array<bigint>"))
    return texts.join(cells, "doc_id", "left").union(placeless).mapInArrow(_kept, out)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    got = without_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM g
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM f WHERE k > 1) GROUP BY doc_id
), e AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(len(gone.p), 0) AS n_removed,
         list_filter(w.w, lambda x, i: gone.p IS NULL OR NOT list_contains(gone.p, i)) AS kept
  FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM e
"""
