"""Benchmark decontamination by a distributed positional inverted index.

The index holds postings (term, doc_id, pos) of the training documents. A query reads the lists of the rarest
terms only, so only those are stored for a set of test items: a first pass counts the test terms in the
documents, each test window takes its two rarest terms, and a second pass stores their postings. Lists are
intersected after an offset adjustment: a posting of the item's term at place p at document place q proposes
the alignment q - p, and both terms must propose it. Alignments are then checked word by word on the documents.

Test items are taken in blocks of bounded size against all documents, so what the driver and the tasks hold of
them doesn't grow with the benchmark.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .words import PUNCTUATION, U64, Words, parts, signed

WINDOW = 13
#: Words of test items in a block (8 bytes each on the driver and in each task).
BLOCK_WORDS = 500_000
#: Alignments (16 bytes each) that are told to all tasks, where there are no more; else texts are shuffled to them.
TOLD = 500_000
_FILTER = 20


class Block:
    """Some test items: the hashes of their words end to end, and which terms to look up."""

    def __init__(self, ids: list, items: list[np.ndarray]):
        self.ids, self.sizes = ids, [len(x) for x in items]
        self.at = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.words = np.concatenate(items)
        self.terms = np.unique(self.words)

    def lookups(self, counts: np.ndarray, window: int) -> tuple[list, list, list, list, list]:
        """Of each window the places of its two rarest terms in its item; windows with an absent term are left out."""
        seen, place = counts[np.searchsorted(self.terms, self.words)], []
        for k, n in enumerate(self.sizes):
            c, w = seen[self.at[k] : self.at[k + 1]], self.words[self.at[k] : self.at[k + 1]]
            for lo in range(max(1, n - window + 1)):
                part = c[lo : lo + window]
                if part.min() == 0:
                    continue
                # ties by term, so that neighbouring windows look up the same
                two = np.lexsort((np.arange(len(part)), w[lo : lo + window], part))[:2] + lo
                place.append((k, int(two[0]), int(two[-1])))
        place = sorted(set(place))
        one = [self.words[self.at[k] + p] for k, p, _ in place]
        two = [self.words[self.at[k] + q] for k, _, q in place]
        return [k for k, _, _ in place], [p for _, p, _ in place], [q for _, _, q in place], one, two


def _bits(terms: np.ndarray) -> np.ndarray:
    found = np.zeros(1 << _FILTER, dtype=bool)
    found[(terms >> U64(64 - _FILTER)).astype(np.int64)] = True
    return found


def _hits(h: np.ndarray, terms: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where h has one of the sorted terms, and which."""
    if not len(terms):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero(bits[(h >> U64(64 - _FILTER)).astype(np.int64)])
    k = np.searchsorted(terms, h[at])
    k[k == len(terms)] = 0
    good = terms[k] == h[at]
    return at[good], k[good]


def _count(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_, bits = terms.value, _bits(terms.value)
        total = np.zeros(len(terms_), dtype=np.int64)
        for batch in parts(batches):
            total += np.bincount(_hits(Words(batch.column("text"), PUNCTUATION, lower=True).hashes(), terms_, bits)[1], minlength=len(terms_))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([signed(terms_[some]), pa.array(total[some])], ["term", "n"])

    return run


def _postings(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_, bits = terms.value, _bits(terms.value)
        for batch in parts(batches):
            w = Words(batch.column("text"), PUNCTUATION, lower=True)
            at, k = _hits(w.hashes(), terms_, bits)
            row = np.searchsorted(w.ptr, at, side="right") - 1
            ids = batch.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([signed(terms_[k]), ids, pa.array(at - w.ptr[row])], ["term", "doc_id", "pos"])

    return run


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The index: (term, doc_id, pos), a row for each occurrence of one of the sorted term hashes."""
    told = docs.sparkSession.sparkContext.broadcast(terms)
    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(_postings(told), "term long, doc_id long, pos long")


def term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the sorted term hashes occurs in all documents."""
    told = docs.sparkSession.sparkContext.broadcast(terms)
    rows = docs.select("text").mapInArrow(_count(told), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(terms), dtype=np.int64)
    counts[np.searchsorted(terms, rows["term"].to_numpy(np.int64).view(U64))] = rows["n"]
    return counts


def blocks(items: DataFrame, most: int = BLOCK_WORDS) -> Iterator[Block]:
    """Items (item_id, text) in blocks; items without a word are in none."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            w = Words(batch.column("text"), PUNCTUATION, lower=True)
            h = w.hashes()
            blobs = [h[a:b].tobytes() for a, b in zip(w.ptr[:-1], w.ptr[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(blobs, pa.binary())], ["item_id", "w"])

    ids, words, size = [], [], 0
    rows = items.select(F.col("item_id").cast("string"), "text").where("item_id is not null")
    for row in rows.mapInArrow(hashed, "item_id string, w binary").toLocalIterator():
        if len(row.w):
            ids.append(row.item_id)
            words.append(np.frombuffer(bytes(row.w), dtype=U64))
            size += len(words[-1])
        if size >= most:
            yield Block(ids, words)
            ids, words, size = [], [], 0
    if ids:
        yield Block(ids, words)


def _check(block, window: int):
    """Of each document the items that occur in it, and the runs of words that their windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in parts(batches):
            w = Words(batch.column("text"), PUNCTUATION, lower=True)
            h, row, item, lo, hi = w.hashes(), [], [], [], []
            for r, cells in enumerate(batch.column("cells")):
                doc = h[w.ptr[r] : w.ptr[r + 1]]
                for k, shift in zip(cells.values.field("item").to_numpy(), cells.values.field("shift").to_numpy()):
                    words = b.words[b.at[k] : b.at[k + 1]]
                    a, z = max(0, shift), min(len(doc), shift + len(words))
                    if z - a < min(window, len(words)):
                        continue
                    same = np.concatenate([[False], doc[a:z] == words[a - shift : z - shift], [False]])
                    edge = np.flatnonzero(same[1:] != same[:-1])
                    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        if e - s >= min(window, len(words)):
                            row.append(r), item.append(b.ids[k]), lo.append(a + s), hi.append(a + e)
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["doc_id", "item_id", "lo", "hi"])

    return run


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id string, lo, hi): words lo..hi-1 of the document are covered by equal windows of the item.

    A window is `window` consecutive words of an item, or all words of a shorter one. Every occurrence is found.
    """
    spark = docs.sparkSession
    out = "doc_id long, item_id string, lo long, hi long"
    found = spark.createDataFrame([], out)
    for block in blocks(items):
        item, p, q, one, two = block.lookups(term_counts(docs, block.terms), window)
        if not item:
            continue
        terms = np.unique(np.array(one + two, dtype=U64))
        index = stored(postings(docs, terms), "postings")
        as_long = lambda x: np.array(x, dtype=U64).view(np.int64).tolist()
        ask = spark.createDataFrame(
            list(zip(item, p, q, as_long(one), as_long(two))), "item int, p long, q long, one long, two long"
        )
        first = index.join(F.broadcast(ask), index["term"] == ask["one"]).selectExpr("doc_id", "item", "two", "pos - p as shift", "pos - p + q as other")
        second = index.selectExpr("doc_id", "term as two", "pos as other")
        aligned = first.join(second, ["doc_id", "two", "other"], "left_semi").select("doc_id", "item", "shift")
        cells = stored(aligned.groupBy("doc_id").agg(F.collect_set(F.struct("item", "shift")).alias("cells")), "cells")
        few = (cells.agg(F.sum(F.size("cells"))).first()[0] or 0) <= TOLD
        texts = docs.select("doc_id", "text").join(F.broadcast(cells) if few else cells, "doc_id")
        found = found.union(texts.mapInArrow(_check(spark.sparkContext.broadcast(block), window), out))
    return found


def _near(block, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in parts(batches):
            w = Words(batch.column("text"), PUNCTUATION, lower=True)
            h, row, item, spans = w.hashes(), [], [], []
            for r, cells in enumerate(batch.column("cells")):
                doc = h[w.ptr[r] : w.ptr[r + 1]]
                for k in sorted(set(cells.values.to_pylist())):
                    terms = np.unique(b.words[b.at[k] : b.at[k + 1]])
                    at, which = _hits(doc, terms, _bits(terms))
                    last, best = dict.fromkeys(range(len(terms)), -1), None
                    for p, t in zip(at.tolist(), which.tolist()):
                        last[t] = p
                        low = min(last.values())
                        if low >= 0 and (best is None or p - low + 1 < best):
                            best = p - low + 1
                    if best is not None and best <= b.sizes[k] + slack:
                        row.append(r), item.append(b.ids[k]), spans.append(best)
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(item, pa.string()), pa.array(spans, pa.int64())], ["doc_id", "item_id", "span"])

    return run


def proximity_matches(docs: DataFrame, items: DataFrame, slack: int = 5) -> DataFrame:
    """(doc_id, item_id string, span long): documents in which all terms of an item stand, in any order, within
    (words of the item + slack) words; span is the shortest such stretch. Candidates hold the rarest two terms so near.

    Texts without words, null texts and rows without an id match nothing; repeated rows are one document or item."""
    spark = docs.sparkSession
    out = "doc_id long, item_id string, span long"
    found = spark.createDataFrame([], out)
    for block in blocks(items):
        counts = term_counts(docs, block.terms)
        ask = []
        for k, n in enumerate(block.sizes):
            terms = np.unique(block.words[block.at[k] : block.at[k + 1]])
            c = counts[np.searchsorted(block.terms, terms)]
            if c.min() > 0:
                two = terms[np.argsort(c, kind="stable")[:2]].view(np.int64)
                ask.append((k, n + slack, int(two[0]), int(two[-1])))
        if not ask:
            continue
        asked = np.unique(np.array([x for a in ask for x in a[2:]], dtype=np.int64).view(U64))
        index = stored(postings(docs, asked), "postings")
        ask = spark.createDataFrame(ask, "item int, reach long, one long, two long")
        first = index.join(F.broadcast(ask), index["term"] == ask["one"]).selectExpr("doc_id", "item", "two", "reach", "pos as p", "explode(array(floor(pos / reach) - 1, floor(pos / reach), floor(pos / reach) + 1)) as cell")
        second = index.join(F.broadcast(ask.selectExpr("two", "item", "reach")), index["term"] == F.col("two")).selectExpr("doc_id", "item", "pos as o", "floor(pos / reach) as cell")
        near = first.join(second, ["doc_id", "item", "cell"]).where("abs(p - o) < reach").select("doc_id", "item")
        cells = near.groupBy("doc_id").agg(F.collect_set("item").alias("cells"))
        texts = docs.select("doc_id", "text").join(cells, "doc_id")
        found = found.union(texts.mapInArrow(_near(spark.sparkContext.broadcast(block), slack), out))
    return found


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        n = np.diff(Words(batch.column("text"), PUNCTUATION, lower=True).ptr)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_words"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id long, text string, ...), items (item_id, text string, ...) -> a row for each row of docs:
    (doc_id, n_words long, n_hit long, items array<string>, contaminated boolean).

    Words: runs of [0-9a-z] and non-ASCII after lower-casing A-Z. A word is hit that an occurrence of an item's
    window covers; items are those with an occurrence, sorted, each once. Contaminated: a word is hit, and one in
    twenty at least. Null, empty and wordless texts have no words. Repeated items count once by item_id; items
    without item_id or words match nothing. Rows with one doc_id are one document and must be equal. Rows without
    doc_id have no hits. Further columns are ignored. No items, or no documents: no hits, or no rows.
    """
    runs = stored(phrase_matches(docs, items, window), "matches")
    # runs are merged in order of their start; the fold carries the end so far and the words covered
    merged = F.expr(
        "aggregate(array_sort(runs), struct(0L as e, 0L as n), (a, x) -> struct(greatest(a.e, x.hi) as e, "
        "a.n + greatest(0L, x.hi - greatest(a.e, x.lo)) as n), a -> a.n)"
    )
    hits = (
        runs.groupBy("doc_id")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("runs"), F.array_sort(F.collect_set("item_id")).alias("items"))
        .select("doc_id", merged.alias("n_hit"), "items")
    )
    sizes = docs.select("doc_id", "text").mapInArrow(_sizes, "doc_id long, n_words long")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return sizes.join(hits, "doc_id", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), iv AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM iw WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM iv),
dv AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)
), m AS (SELECT dv.doc_id, dv.i, dv.n, iv.item_id FROM dv JOIN iv ON iv.n = dv.n AND iv.s = dv.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT cast(item_id AS VARCHAR))) AS items FROM m GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN t ON t.doc_id = dw.doc_id
"""
