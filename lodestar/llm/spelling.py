"""Spelling variants: which words of a corpus are one edit from each other, and which frequent word each stands for.

Words are counted once; what is compared is the vocabulary. A word of L code points has L - 2 positional 3-grams, and
one edit touches at most three of them, so two words of at most L code points that are one edit apart share
T = L - 5 grams at equal places, or one place on behind an inserted code point (the count filter's bound). Of grams in
one order (rarest first) the first shared one is therefore among the first |grams| - T + 1 of both words: four, or
three of the shorter word. A word is posted under these alone, by gram, place and length, which deals the inverted
index out over the cluster.

A group of one gram, place and length is an index of its own: postings of all grams of its words. For each word the
shortest postings lists, as many as can't all be missed, are laid side by side and merged; candidates that meet in them
are counted over all their grams, kept at T shared ones, and verified letter by letter. Groups of more than `hot` words
aren't held: their posts go on under that gram and one more, which keeps every pair as long as T says there is one.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, table
from .words import U64, mix, signed

#: Runs of these are words. One code point of a run is deleted where the hash of document and run says so.
RUN = "[A-Za-zÀ-ÿ]+"
DELETE_EVERY = 31
LEAST_LENGTH, LEAST_TIMES = 7, 2
#: A word's form is its most frequent near word, if that is so many times as frequent.
TIMES = 10
GRAM = 3
#: Letters by number: a-z, then U+00C0 to U+00FF; so there are 90 ** 3 grams at most.
LETTERS = 90
GRAMS = LETTERS**GRAM
#: Words of one gram, place and length that a task compares at once; rows it takes together; candidates it holds.
HOT, CHUNK, CANDIDATES = 1 << 15, 1 << 14, 1 << 20
#: Distinct words that a task counts before it passes them on.
COUNTED = 1 << 18


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w binary, n): words in Latin-1, a byte a code point, with how often they occur in a part of the texts."""
    runs, found = re.compile(RUN).findall, Counter()

    def rows() -> pa.RecordBatch:
        keys = pa.array([w.encode("latin-1") for w in found], pa.binary())
        return pa.RecordBatch.from_arrays([keys, pa.array(list(found.values()), pa.int64())], ["w", "n"])

    for batch in batches:
        for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            if not value.is_valid:
                continue
            low = value.as_buffer().to_pybytes().lower().decode()  # bytes lower only A-Z
            of = "" if doc_id is None else doc_id
            for run, n in Counter(runs(low)).items():
                if len(run) < LEAST_LENGTH:
                    continue
                h = zlib.crc32(f"{of}:{run}".encode())
                if h % DELETE_EVERY == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LENGTH:
                        continue
                found[run] += n
            if len(found) >= COUNTED:
                yield rows()
                found.clear()
    if found:
        yield rows()


def vocabulary(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> (w binary, n long): the distinct words in Latin-1 with their occurrences."""
    return docs.select("doc_id", "text").mapInArrow(_counted, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


class Grams:
    """The positional grams of some words; grams of word r are at ptr[r] to ptr[r + 1], in order of place."""

    def __init__(self, words: pa.Array):
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = words.buffers()[2]
        buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.letters = np.where(buf < 0xC0, buf - 97, buf.astype(np.int32) - 0xC0 + 26).astype(np.int32)
        self.length = np.diff(self.offsets)
        count = np.maximum(self.length - GRAM + 1, 0)
        self.ptr = np.concatenate([[0], np.cumsum(count)])
        self.row = np.repeat(np.arange(len(count)), count)
        self.place = np.arange(self.ptr[-1]) - self.ptr[:-1][self.row]
        at = self.offsets[:-1][self.row] + self.place
        x = self.letters
        self.gram = (x[at] * LETTERS + x[at + 1]) * LETTERS + x[at + 2] if len(at) else np.empty(0, np.int32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(GRAMS, np.int64)
    for batch in batches:
        total += np.bincount(Grams(batch.column("w")).gram, minlength=GRAMS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])


def gram_frequencies(words: DataFrame) -> np.ndarray:
    """How many places of the words hold each gram; there are GRAMS of them, however many words."""
    got = words.select("w").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(GRAMS, np.int64)
    out[got["gram"].to_numpy()] = got["n"].to_numpy()
    return out


#: key: of what the group shares. near: the length of the group's words less the row's, 0 or 1 (then the row only asks).
#: last: the rank of the last gram in the key, in the order of the word's grams. shared: grams in the key.
POST = "key long, near byte, last int, shared byte, w binary, n long"


def _order(g: Grams, frequency: np.ndarray) -> np.ndarray:
    """The grams of each word in the common order, rarest first: indexes into g.gram, from g.ptr[r] on for word r."""
    by = np.lexsort((g.place, g.gram, frequency[g.gram], g.row))
    return by


def _extended(g: Grams, order: np.ndarray, key: np.ndarray, near: np.ndarray, last: np.ndarray, shared: np.ndarray):
    """Posts with one more gram in their keys: (rows, their keys, ranks of that gram)."""
    length = g.length + near
    need = length - 2 * GRAM + 1  # T: shared grams of a pair whose longer word has this length
    count = np.diff(g.ptr)
    # behind the (shared + 1)-th of the shared grams there are T - shared - 1 more
    ends = count - need + shared + 1
    n = np.maximum(np.where(shared < need, ends - (last + 1), 0), 0)
    row = np.repeat(np.arange(len(n)), n)
    rank = last[row] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = order[g.ptr[:-1][row] + rank]
    rows, keys, ranks = [], [], []
    for shift in (0, 1):
        some = np.flatnonzero(near[row] >= shift)
        x = (g.gram[at[some]].astype(np.uint64) << U64(32)) | (g.place[at[some]] + shift).astype(np.uint64)
        before = key[row[some]].view(np.uint64)
        keys.append(mix(mix(x) + before * U64(0x9E3779B97F4A7C15) + U64(1)))
        rows.append(row[some])
        ranks.append(rank[some])
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(ranks)


def _posts(frequency: np.ndarray, deferred: bool):
    """Posts of words, or posts with one gram more of those that were put off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                words, n = part.column("w"), part.column("n")
                if not deferred:
                    twice = pa.array(np.repeat(np.arange(part.num_rows), 2))
                    words, n = words.take(twice), n.take(twice)
                g = Grams(words)
                if deferred:
                    key, near, last, shared = (np.asarray(part.column(c)) for c in ("key", "near", "last", "shared"))
                    near, last, shared = near.astype(np.int64), last.astype(np.int64), shared.astype(np.int64)
                else:  # once as a word of its own length, once as one that asks longer ones
                    near = np.arange(len(words)) % 2
                    key, last, shared = (g.length + near).astype(np.int64), np.full(len(words), -1), np.zeros(len(words), np.int64)
                rows, keys, ranks = _extended(g, _order(g, frequency), key, near, last, shared)
                to = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(near[rows].astype(np.int8)), pa.array(ranks.astype(np.int32)), pa.array((shared[rows] + 1).astype(np.int8)), words.take(to), n.take(to)],
                    ["key", "near", "last", "shared", "w", "n"],
                )

    return run


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... n[0] numbers, then lo[1] ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - n), n)


def _near(g: Grams, group: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart: (asking row, row of the index), within groups. asks: 1 where the row is one code
    point shorter than the group's words and isn't in the index. Of two words of one length the earlier row asks."""
    indexed = np.flatnonzero(asks[g.row] == 0)
    spot = lambda at, extra: (group[g.row[at]].astype(np.uint64) << U64(44)) | (g.gram[at].astype(np.uint64) << U64(24)) | ((g.place[at] + extra).astype(np.uint64) & U64((1 << 24) - 1))
    postings = spot(indexed, 0)
    by = np.argsort(postings, kind="stable")
    postings, holder = postings[by], g.row[indexed][by]
    every = np.arange(len(g.gram))
    low = np.searchsorted(postings, spot(every, 0), "left")
    size = np.searchsorted(postings, spot(every, asks[g.row]), "right") - low
    # the shortest lists, one more than may be missed
    shortest = np.argsort((g.row.astype(np.uint64) << U64(32)) | size.astype(np.uint64), kind="stable")
    count = np.diff(g.ptr)
    need = g.length + asks - 2 * GRAM + 1
    merged = shortest[_ranges(g.ptr[:-1], np.minimum(count - need + 1, count))]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    row, total = g.row[merged], np.cumsum(size[merged])
    at = 0
    while at < len(merged):  # whole rows with some CANDIDATES each
        to = np.searchsorted(total, (total[at - 1] if at else 0) + CANDIDATES, "right")
        to = np.searchsorted(row, row[min(to, len(row) - 1)], "left") if to < len(row) else to
        to = max(to, np.searchsorted(row, row[at], "right"))
        some = merged[at:to]
        a, b = np.repeat(g.row[some], size[some]), holder[_ranges(low[some], size[some])]
        fits = (asks[a] == 1) | (b > a)
        runs = np.sort((a[fits] << 32) | b[fits], kind="stable")
        pairs = runs[np.r_[True, runs[1:] != runs[:-1]]] if len(runs) else runs
        found.append(_verified(g, asks, pairs >> 32, pairs & ((1 << 32) - 1)))
        at = to
    return tuple(np.concatenate(x) if found else np.empty(0, np.int64) for x in (zip(*found) if found else ((), ())))


def _verified(g: Grams, asks: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates those with the bound's count of shared grams whose letters differ by one edit."""
    n = np.diff(g.ptr)[a]
    x, y = _ranges(g.ptr[:-1][a], n), _ranges(g.ptr[:-1][b], n)
    pair = np.repeat(np.arange(len(a)), n)
    behind = asks[a][pair]
    shared = (g.gram[x] == g.gram[y]) | (g.gram[x] == g.gram[np.minimum(y + behind, len(g.gram) - 1)])
    enough = np.bincount(pair, weights=shared, minlength=len(a)) >= g.length[b] - 2 * GRAM + 1
    a, b = a[enough], b[enough]
    # letters that agree from the begin, and from the end, over the shorter word's length
    n, more = g.length[a], g.length[b] - g.length[a]
    pair = np.repeat(np.arange(len(a)), n)
    x, y = _ranges(g.offsets[:-1][a], n), _ranges(g.offsets[:-1][b], n)
    place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(n, n)
    front = np.full(len(a), 1 << 60)
    np.minimum.at(front, pair, np.where(g.letters[x] != g.letters[y], place, first))
    back = np.full(len(a), 1 << 60)
    np.minimum.at(back, pair, np.where(g.letters[x] != g.letters[y + more[pair]], first - 1 - place, first))
    one = np.where(more == 1, front + back >= n, front + back == n - 1)
    return a[one], b[one]


#: Rows of pairs (a, b, n_a, n_b), and of posts that are put off (key not null).
FOUND = "a binary, b binary, n_a long, n_b long, " + POST


def _compared(hot: int):
    """Rows sorted by key, index rows before those that only ask -> pairs, and the posts of groups too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posts = ["key", "near", "last", "shared", "w", "n"]
        none = lambda n, t: pa.nulls(n, t)

        def pairs(rows: pa.RecordBatch) -> pa.RecordBatch | None:
            key, near = np.asarray(rows.column("key")), np.asarray(rows.column("near")).astype(np.int64)
            group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            size = np.bincount(group)
            kept = np.flatnonzero((size[group] > 1) & (np.bincount(group, weights=near == 0)[group] > 0))
            if not len(kept):
                return None
            w, n = rows.column("w").take(pa.array(kept)), np.asarray(rows.column("n"))[kept]
            a, b = _near(Grams(w), group[kept], near[kept])
            if not len(a):
                return None
            return pa.RecordBatch.from_arrays(
                [w.take(pa.array(a)), w.take(pa.array(b)), pa.array(n[a]), pa.array(n[b]), *(none(len(a), t) for t in (pa.int64(), pa.int8(), pa.int32(), pa.int8(), pa.binary(), pa.int64()))],
                ["a", "b", "n_a", "n_b", *posts],
            )

        def put_off(rows: pa.RecordBatch) -> pa.RecordBatch:
            n = rows.num_rows
            return pa.RecordBatch.from_arrays([*(none(n, t) for t in (pa.binary(), pa.binary(), pa.int64(), pa.int64())), *(rows.column(c) for c in posts)], ["a", "b", "n_a", "n_b", *posts])

        held: pa.RecordBatch | None = None
        large = None  # the key of a group that is being put off
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                rows = batch.slice(lo, CHUNK)
                if large is not None:
                    end = int(np.searchsorted(np.asarray(rows.column("key")), large, "right"))
                    if end:
                        yield put_off(rows.slice(0, end))
                    if end == rows.num_rows:
                        continue
                    large, rows = None, rows.slice(end)
                held = rows if held is None else pa.concat_batches([held, rows])
                key = np.asarray(held.column("key"))
                begin = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on
                if begin and (got := pairs(held.slice(0, begin))) is not None:
                    yield got
                held = held.slice(begin)
                members = int(np.count_nonzero(np.asarray(held.column("near")) == 0))
                if members > hot:
                    yield put_off(held)
                    large, held = key[-1], None
                elif held.num_rows - members >= max(CHUNK, members):
                    # the index is whole; these rows have asked. Its own pairs are found each time, which costs as much again
                    if members and (got := pairs(held)) is not None:
                        yield got
                    held = held.slice(0, members) if members else None
        if held is not None and (got := pairs(held)) is not None:
            yield got

    return run


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """words (w binary, n long) -> (a, b, n_a, n_b): the pairs one edit apart, once, a before b by length, then letters."""
    frequency = gram_frequencies(words)
    rows, found, deferred = words.select("w", "n"), [], False
    while True:
        posts = rows.mapInArrow(_posts(frequency, deferred), POST).repartition("key").sortWithinPartitions("key", "near", "w")
        got = stored(posts.mapInArrow(_compared(hot), FOUND), "near")
        found.append(got)
        rows, deferred = got.where("key is not null").select("key", "near", "last", "shared", "w", "n"), True
        if rows.isEmpty():
            break
    pairs = found[0].where("key is null").select("a", "b", "n_a", "n_b")
    for more in found[1:]:
        pairs = pairs.union(more.where("key is null").select("a", "b", "n_a", "n_b"))
    out = stored(pairs.distinct(), "pairs")
    discard(*found)
    return out


def variants(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text string, ...) -> (word, form, root string, n, n_near, form_n long), a row for each word.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF in the texts, of which only A-Z are lower-cased; in one of 31 cases,
    by the crc32 of `<doc_id>:<run>`, a code point is deleted first. Those of at least 7 code points that occur at least
    twice are returned. Near words differ by one inserted, deleted or replaced code point; n_near counts them. form is
    the most frequent near word (ties: the smallest in code-point order) if it occurs at least ten times as often as the
    word; else it and form_n are null. root follows forms to the last one.

    A null or empty text has no words; a null doc_id counts as an empty one; every row counts, repeated ones too.
    Further columns are ignored. No words: no rows. `hot` bounds the words a task holds of one group; the result is the
    same for any.
    """
    words = stored(vocabulary(docs), "words")
    pairs = near_words(words, hot)
    one = pairs.selectExpr("a as w", "b as other", "n_b as m").union(pairs.selectExpr("b as w", "a as other", "n_a as m"))
    # a word has at most (2 * length + 1) * 90 near words
    best = one.groupBy("w").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    enough = -F.col("best.m") >= TIMES * F.col("n")
    told = stored(
        words.join(best, "w", "left").select("w", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.m")).alias("form_n")), "forms"
    )
    discard(pairs, words)
    # each form occurs ten times as often as the word before, so chains are short; every round halves them
    roots = stored(told.where("form is not null").select("w", F.col("form").alias("root")), "roots")
    while True:
        up = roots.select(F.col("w").alias("root"), F.col("root").alias("top"))
        step = stored(roots.join(up, "root", "left").select("w", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        discard(roots)
        roots = step
        if roots.where("moved").isEmpty():
            break
    text = lambda c: F.decode(F.col(c), "ISO-8859-1")
    return told.join(roots.select("w", "root"), "w", "left").select(
        text("w").alias("word"), text("form").alias("form"), F.coalesce(text("root"), text("w")).alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: crc32 goes by half bytes; near pairs by equal words or equal places after a deletion.
SQL = r"""
WITH RECURSIVE half AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(16) AS x(i)
  )
), runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
  ) WHERE length(run) >= 7 GROUP BY ALL
), coded AS (
  SELECT run, c, hex(encode(concat(doc_id, ':', run))) AS x FROM runs
), hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(length(x)), lambda k: (strpos('0123456789ABCDEF', x[CASE WHEN k % 2 = 0 THEN k + 2 ELSE k END]) - 1)::BIGINT)),
    lambda a, b: xor(a >> 4, t[(xor(a, b) & 15) + 1]))) AS h
  FROM coded, half
), counted AS (
  SELECT w, sum(c) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS w, c FROM hashed
  ) WHERE length(w) >= 7 GROUP BY w HAVING sum(c) >= 2
), cut AS (
  SELECT w, i, w[:i] || w[i + 2:] AS x FROM (SELECT w, unnest(range(length(w))) AS i FROM counted)
), near AS (
  SELECT cut.w AS a, counted.w AS b FROM cut JOIN counted ON counted.w = x
  UNION SELECT counted.w, cut.w FROM cut JOIN counted ON counted.w = x
  UNION SELECT p.w, q.w FROM cut AS p JOIN cut AS q ON p.i = q.i AND p.x = q.x AND p.w <> q.w
), best AS (
  SELECT a, count(*) AS n_near, min({'m': -counted.n, 'w': b}) AS f FROM near JOIN counted ON b = w GROUP BY a
), told AS (
  SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -f.m >= 10 * n THEN f.w END AS form, CASE WHEN -f.m >= 10 * n THEN -f.m END AS form_n
  FROM counted LEFT JOIN best ON a = w
), way AS (
  SELECT w AS src, w AS dst FROM told UNION ALL SELECT src, form FROM way JOIN told ON dst = w WHERE form IS NOT NULL
)
SELECT told.w AS word, told.form, dst AS root, told.n::BIGINT AS n, told.n_near, told.form_n::BIGINT AS form_n
FROM told JOIN way ON src = told.w JOIN told AS last ON last.w = dst AND last.form IS NULL
"""
