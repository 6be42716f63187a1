"""Katz backoff language model: Good-Turing discounted n-gram counts, exactly normalised backoff weights.

Documents go in blocks of some megabytes. A block lists its distinct n-grams (64-bit hashes, sorted) with their
occurrences in its training documents, and sends each hash range its part. A range adds them up over all blocks and
answers each block with the whole corpus' counts in its own order, a byte or two for each; so an n-gram crosses the
shuffle once a block and not once a document, and no n-gram is hot. A range also tells how many n-grams occur once,
twice and so on, which is all that discounts need, and names for each n-gram one block that speaks for it. A history's
count is that of the n-gram it is, as every word has a token behind it; the history of begins is as frequent as ends.

With these counts a block has every probability that needs no backoff weight. The weight of a history is

    weight(h) = what discounts leave of h / (1 - sum of lower-order probabilities of the words seen after h),

and as these all have one denominator, it follows from whole numbers: how many n-grams after h occur once, twice and so
on, and the same of their lower-order n-grams. A block adds them up for the n-grams it speaks for and sends them to hash
ranges of histories, with the histories it needs weights for; it gets back what they come to over all blocks. Tokens are
evaluated from the longest n-gram down to the first that is known; weights are needed only where a document backs off
from a known history.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .centroids import Bucketed
from .common import discard, stored, table
from .words import U64, WHITE, Words, combine, mix, parts

ORDER = 2
#: Every seventh document by crc32 is held out.
FOLDS, HELD_OUT = 7, 2
#: Counts up to this are discounted.
DISCOUNTED = 5
#: Bytes of text in a block; n-grams and histories that a hash range has of all blocks, about; the least ranges.
BLOCK_BYTES, RANGE_KEYS, LEAST_RANGES = 4 << 20, 2_000_000, 48
#: Hashes of what isn't a word.
START, END = (mix(np.array([x], U64))[0] for x in (11, 13))
#: Low bits of a key tell its order: n - 1 for an n-gram and for a history of n-grams.
KINDS = U64(3)


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, their low bytes first and no more of them than the largest needs; compressed where that pays."""
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    if len(planes) < 512:
        return bytes([width]) + planes
    return bytes([width | 16]) + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    width = data[0] & 15
    planes = pa.decompress(data[1:], width * n, "zstd", asbytes=True) if data[0] & 16 else data[1:]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


_BLOCK = "block long, ids array<long>, sizes array<long>, bytes long, text binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 33
    ids, texts, held = [], [], 0

    def row() -> pa.RecordBatch:
        whole = b"".join(texts)
        data = [[block], [ids], [[len(t) for t in texts]], [len(whole)], [pa.compress(whole, "zstd", asbytes=True)]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, types)], ["block", "ids", "sizes", "bytes", "text"])

    for batch in batches:
        for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids.append(doc_id)
            texts.append(value.as_buffer().to_pybytes() if value.is_valid else b"")
            held += len(texts[-1])
            if held >= BLOCK_BYTES:
                yield row()
                block, ids, texts, held = block + 1, [], [], 0
    if ids:
        yield row()


class Block:
    """The tokens of a block and, for each, the hashes of its n-grams and their histories, by order."""

    def __init__(self, row: dict, order: int):
        self.ids = row["ids"]
        sizes = np.array(row["sizes"], dtype=np.int64)
        data = pa.decompress(row["text"], row["bytes"], "zstd", asbytes=True) if row["bytes"] else b""
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
        hashes, counts = [np.empty(0, U64)], [np.empty(0, np.int64)]
        for part in parts(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
            w = Words(part.column("text"), WHITE, lower=True)
            hashes.append(w.hashes())
            counts.append(np.diff(w.ptr))
        words, n = np.concatenate(hashes), np.concatenate(counts)
        pad = order - 1
        self.n_tokens = n + 1
        begin = np.concatenate([[0], np.cumsum(n + 1 + pad)])
        padded = np.full(begin[-1], START, U64)
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        at = np.arange(len(self.doc)) + (self.doc + 1) * pad  # places of tokens
        last = begin[1:] - 1
        padded[last] = END
        real = np.ones(len(self.doc), bool)
        real[np.cumsum(n + 1) - 1] = False  # ends
        padded[at[real]] = words
        token, history = padded[at], None
        self.grams, self.histories = [(mix(token) & ~KINDS)], []
        for k in range(2, order + 1):
            before = padded[at - (k - 1)]
            history = before if history is None else combine(before, history)
            self.histories.append((mix(history + U64(k)) & ~KINDS) | U64(k - 1))
            self.grams.append((combine(history, token) & ~KINDS) | U64(k - 1))
        self.begins, self.ends = np.cumsum(n + 1) - n - 1, np.cumsum(n + 1) - 1
        self.held_out = np.array([held_out(x) for x in self.ids], bool)
        self.training = ~self.held_out[self.doc]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys, of each a place in the run of all n-grams, the key's number at each place)."""
        every = np.concatenate(self.grams)
        by = np.argsort(every, kind="stable").astype(np.int32)  # a block has fewer tokens than that
        ordered = every[by]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(by) else np.empty(0, bool)
        number = np.empty(len(by), np.int32)
        number[by] = np.cumsum(new, dtype=np.int32) - 1
        return ordered[new], by[new], number


def _bounds(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted keys fall into, and where each begins, with the end."""
    to = ((keys >> U64(40)) * U64(ranges) >> U64(24)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
    return to[first], np.r_[first, len(to)]


def _shares(order: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row, order)
                keys, _, number = block.distinct()
                times = np.bincount(number, weights=np.tile(block.training, order), minlength=len(keys)).astype(np.int64)
                to, ends = _bounds(keys, ranges)
                cut = list(zip(ends[:-1], ends[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to), pa.array([row["block"]] * len(to), pa.int64()), pa.array(np.diff(ends)),
                        pa.array([packed(np.diff(keys[a:b], prepend=U64(0))) for a, b in cut], pa.binary()), pa.array([packed(times[a:b]) for a, b in cut], pa.binary()),
                    ],
                    ["range", "block", "n", "keys", "times"],
                )

    return run


ANSWER = "block long, range long, n long, counts binary, stats array<long>"


def _counted(order: int):
    """Of one range the parts of all blocks -> its answer to each, 2 * count + (the block speaks for it); and a row
    without block: for each order how many n-grams occur 1, 2, .. DISCOUNTED + 1 times, how many there are, and their
    occurrences."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        sizes = [r["n"] for r in rows]
        keys = np.concatenate([np.cumsum(unpacked(r["keys"], r["n"]), dtype=U64) for r in rows])
        times = np.concatenate([unpacked(r["times"], r["n"]) for r in rows]).astype(np.int64)
        by = np.lexsort((times == 0, keys))  # blocks that have it in training first
        ordered = keys[by]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        total = np.add.reduceat(times[by], first)
        answer = np.empty(len(keys), np.int64)
        answer[by] = np.repeat(total, np.diff(np.r_[first, len(keys)])) * 2
        answer[by[first]] += total > 0
        kind, stats = (ordered[first] & KINDS).astype(np.int64), []
        for n in range(order):
            c = total[(kind == n) & (total > 0)]
            stats += [*(int((c == r).sum()) for r in range(1, DISCOUNTED + 2)), len(c), int(c.sum())]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        blobs = [packed(answer[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        of = rows[0]["range"]
        return pa.table(
            [
                pa.array([r["block"] for r in rows] + [None], pa.int64()), pa.array([of] * (len(rows) + 1), pa.int64()), pa.array([*sizes, 0], pa.int64()),
                pa.array([*blobs, None], pa.binary()), pa.array([None] * len(rows) + [stats], pa.list_(pa.int64())),
            ],
            ["block", "range", "n", "counts", "stats"],
        )

    return run


def discounts(times: list[int]) -> np.ndarray:
    """Katz's factors d[r] of counts r = 0, 1, .. by Good-Turing, from how many n-grams occur 1, 2, .. times; counts
    beyond the last aren't discounted. Taken are the most counts, DISCOUNTED at most, for which all factors lie between
    0 and 1; where that is none, no count is discounted."""
    for most in range(min(DISCOUNTED, len(times) - 1), 0, -1):
        n = [0, *times]
        if any(x == 0 for x in n[1 : most + 1]):
            continue
        common = (most + 1) * n[most + 1] / n[1]
        if common >= 1:
            continue
        d = [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, most + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([1.0, *d])
    return np.array([1.0])


class Model:
    """What all blocks need: discounts by order, and the unigrams' totals.

    A history's denominator is its count, and one more if that is beyond the discounted ones: such a history may have no
    discounted n-gram, and something has to be left for the unseen. The same holds of unigrams, whose rest is the
    probability of any unknown word.
    """

    def __init__(self, stats: list[int], order: int):
        per = DISCOUNTED + 3
        self.order = order
        self.d = [discounts(stats[k * per : k * per + DISCOUNTED + 1]) for k in range(order)]
        self.distinct, self.tokens = stats[per - 2], stats[per - 1]
        once = stats[: DISCOUNTED + 1]
        left = sum((1 - x) * r * once[r - 1] for r, x in enumerate(self.d[0]) if r)
        over = self.tokens >= len(self.d[0])
        self.unknown = (left + over) / (self.tokens + over) if self.tokens else 1.0

    def discounted(self, k: int, count: np.ndarray) -> np.ndarray:
        """Discounted counts of n-grams of order k + 1."""
        d = self.d[k]
        return count * np.where(count < len(d), d[np.minimum(count, len(d) - 1)], 1.0)

    def denominator(self, k: int, count: np.ndarray) -> np.ndarray:
        return count + (count >= len(self.d[k]))


def _sums_of(count: np.ndarray, of: np.ndarray, n: int) -> list[np.ndarray]:
    """For each history of n how many counts are 1, 2, .. DISCOUNTED, and the sum of those beyond."""
    some = [np.bincount(of[count == r], minlength=n) for r in range(1, DISCOUNTED + 1)]
    return [*some, np.bincount(of, weights=np.where(count > DISCOUNTED, count, 0), minlength=n).astype(np.int64)]


def _discounted_sum(sums: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The discounted counts that such sums stand for."""
    factors = [d[r] if r < len(d) else 1.0 for r in range(1, DISCOUNTED + 1)]
    return sum(r * f * sums[r - 1] for r, f in enumerate(factors, 1)) + sums[DISCOUNTED]


#: Numbers of a history: of the n-grams after it, and of their lower-order n-grams.
NUMBERS = 2 * (DISCOUNTED + 1)
#: A row of a block (ids not null): its documents, and which weights they need how often; and rows of what it sends to a
#: range of histories: its numbers for some of them, and the ones it needs.
EVALUATED = (
    "block long, ids array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base_score array<double>, score array<double>, "
    "n_pairs long, pairs binary, times binary, counts binary, lower binary, orders binary, range long, n long, keys binary, numbers array<binary>, n_asked long, asked binary"
)
_TYPES = {
    "block": pa.int64(), "ids": pa.list_(pa.int64()), "held_out": pa.list_(pa.bool_()), "n_tokens": pa.list_(pa.int64()), "n_known": pa.list_(pa.int64()), "base_score": pa.list_(pa.float64()),
    "score": pa.list_(pa.float64()), "n_pairs": pa.int64(), "pairs": pa.binary(), "times": pa.binary(), "counts": pa.binary(), "lower": pa.binary(), "orders": pa.binary(),
    "range": pa.int64(), "n": pa.int64(), "keys": pa.binary(), "numbers": pa.list_(pa.binary()), "n_asked": pa.int64(), "asked": pa.binary(),
}


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _TYPES.items()], list(_TYPES))


def _evaluated(model: Model, ranges: int):
    order = model.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from rows(batch.slice(k, 1).to_pylist()[0])

    def rows(row: dict) -> Iterator[pa.RecordBatch]:
        block = Block(row, order)
        keys, place, number = block.distinct()
        answer = np.concatenate([np.empty(0, U64), *(unpacked(x["counts"], x["n"]) for x in row["answers"])]).astype(np.int64)
        size, n_docs = len(block.doc), len(block.ids)
        count = (answer >> 1)[number].reshape(order, size)
        texts = count[0][block.ends[0]]  # training documents have an end each
        history = [np.full(size, model.tokens)]  # of each token's n-gram without the token
        for k in range(1, order):
            h = np.r_[0, count[k - 1][:-1]]
            h[block.begins] = texts
            history.append(h)
        p = [model.discounted(k, count[k]) / np.maximum(model.denominator(k, history[k]), 1) for k in range(order)]
        p[0][count[0] == 0] = model.unknown
        done, score = np.zeros(size, bool), np.zeros(size)
        needs: list[tuple[np.ndarray, ...]] = []
        for k in range(order - 1, -1, -1):
            here = ~done & ((count[k] > 0) | (k == 0))
            score[here] = np.log10(p[k][here])
            done |= here
            if k:
                backs = np.flatnonzero(~done & (history[k] > 0))
                needs.append((block.histories[k - 1][backs], block.doc[backs], history[k][backs], history[k - 1][backs]))
        base = np.log10((count[0] + 1) / (model.tokens + model.distinct + 1))
        total = lambda x: np.bincount(block.doc, weights=x, minlength=n_docs)
        told = {
            "block": row["block"], "ids": block.ids, "held_out": block.held_out, "n_tokens": block.n_tokens, "n_known": total(count[0] > 0).astype(np.int64), "base_score": total(base), "score": total(score), "n_pairs": 0,
        }
        need = np.empty(0, U64)
        if needs:
            every, doc, of_history, of_lower = (np.concatenate(x) for x in zip(*needs))
            need, first, of = np.unique(every, return_index=True, return_inverse=True)
            pairs, times = np.unique((of.astype(np.uint64) << U64(32)) | doc.astype(np.uint64), return_counts=True)
            told |= {
                "n_pairs": len(pairs), "n": len(need), "pairs": packed(np.diff(pairs, prepend=U64(0))), "times": packed(times), "counts": packed(of_history[first]), "lower": packed(of_lower[first]), "orders": packed(need & KINDS),
            }
        yield _rows([told])
        # numbers of the n-grams this block speaks for, by history
        own = np.flatnonzero((answer & 1) == 1)
        spoken, after, lower = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(1, order):
            some = place[own[(keys[own] & KINDS) == U64(k)]] - k * size  # tokens that end them
            spoken.append(block.histories[k - 1][some])
            after.append(count[k][some])
            lower.append(count[k - 1][some])
        heard, of = np.unique(np.concatenate(spoken), return_inverse=True)
        numbers = [*_sums_of(np.concatenate(after), of, len(heard)), *_sums_of(np.concatenate(lower), of, len(heard))]
        parts_: dict[int, dict] = {}
        for what, n, run in (("keys", "n", heard), ("asked", "n_asked", need)):
            to, ends = _bounds(run, ranges)
            for at, a, b in zip(to.tolist(), ends[:-1], ends[1:]):
                got = parts_.setdefault(at, {"range": at, "block": row["block"], "n": 0, "n_asked": 0})
                got |= {n: int(b - a), what: packed(np.diff(run[a:b], prepend=U64(0)))}
                if what == "keys":
                    got["numbers"] = [packed(x[a:b]) for x in numbers]
        if parts_:
            yield _rows(list(parts_.values()))

    return run


def _weighed(model: Model):
    """Of one range of histories the numbers of all blocks -> for each block that needs some the discounted mass of these
    histories and the lower order's discounted counts."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        spoken = [r for r in rows if r["n"]]
        keys = np.concatenate([np.empty(0, U64), *(np.cumsum(unpacked(r["keys"], r["n"]), dtype=U64) for r in spoken)])
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        sums = np.zeros((NUMBERS, len(first)), np.int64)
        for x in range(NUMBERS if len(first) else 0):
            sums[x] = np.add.reduceat(np.concatenate([unpacked(r["numbers"][x], r["n"]) for r in spoken]).astype(np.int64)[by], first)
        keys = keys[first]
        left, lower = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(1, model.order):
            of = (keys & KINDS) == U64(k)
            after, below = sums[: DISCOUNTED + 1, of], sums[DISCOUNTED + 1 :, of]
            left[of] = sum((1 - x) * r * after[r - 1] for r, x in enumerate(model.d[k]) if r)
            lower[of] = _discounted_sum(below, model.d[k - 1])
        blocks, counts, values = [], [], []
        for r in rows:
            if r["n_asked"]:
                at = np.searchsorted(keys, np.cumsum(unpacked(r["asked"], r["n_asked"]), dtype=U64))
                blocks.append(r["block"])
                counts.append(r["n_asked"])
                values.append(left[at].tobytes() + lower[at].tobytes())
        return pa.table([pa.array(blocks, pa.int64()), pa.array([rows[0]["range"]] * len(blocks), pa.int64()), pa.array(counts, pa.int64()), pa.array(values, pa.binary())], ["block", "range", "n", "values"])

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _finished(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                score = np.array(row["score"])
                if row["n_pairs"]:
                    got = [np.frombuffer(x["values"]).reshape(2, -1) for x in row["answers"]]
                    left, below = np.concatenate(got, axis=1)
                    orders, count, lower = (unpacked(row[c], row["n"]).astype(np.int64) for c in ("orders", "counts", "lower"))
                    weight = np.zeros(row["n"])
                    for of in range(1, model.order):
                        here = orders == of
                        over = count[here] >= len(model.d[of])
                        weight[here] = np.log10((left[here] + over) / (count[here] + over) / (1 - below[here] / model.denominator(of - 1, lower[here])))
                    pairs = np.cumsum(unpacked(row["pairs"], row["n_pairs"]), dtype=U64)
                    more = weight[(pairs >> U64(32)).astype(np.int64)] * unpacked(row["times"], row["n_pairs"])
                    score = score + np.bincount((pairs & U64((1 << 32) - 1)).astype(np.int64), weights=more, minlength=len(score))
                columns = [row["ids"], row["held_out"], row["n_tokens"], row["n_known"], row["base_score"], score]
                types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, held_out boolean, n_tokens, n_known, train_tokens long,
    base_score, score double), a row for each row.

    A-Z are lower-cased; tokens are runs of other than space and \\t..\\r, then one end. The model learns from documents
    whose crc32(doc_id) mod 7 isn't 2 (a null id counts as an empty text there) and predicts each token from up to
    order - 1 before it, which begin-of-text tokens precede. score is log10 of the text's probability; base_score is
    that of add-one unigrams. A null or empty text is its end alone. Every row counts, repeated ones too. Words and
    n-grams are known by 64-bit hashes. Without training documents all unknown words have probability 1. Further columns
    are ignored. No rows: no rows. order is 1 to 4.
    """
    if not 1 <= order <= 4:
        raise ValueError("order is 1 to 4")
    tables = Bucketed(docs)
    blocks = tables.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks, _BLOCK), "blocks")
    size = blocks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    ranges = min(1 << 20, max(LEAST_RANGES, size * order // 6 // RANGE_KEYS))  # a word has six bytes or so
    shares = blocks.mapInArrow(_shares(order, ranges), "range long, block long, n long, keys binary, times binary")
    counts = stored(shares.groupBy("range").applyInArrow(_counted(order), ANSWER), "counts")
    stats = counts.where("block is null").select(F.posexplode("stats").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"))
    told = [0] * order * (DISCOUNTED + 3)
    for row in stats.collect():  # eight numbers an order
        told[row["at"]] = row["s"]
    model = Model(told, order)
    answers = counts.where("block is not null").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "n", "counts"))).alias("answers"))
    given = blocks.join(answers.hint("shuffle_hash"), "block")
    rows = stored(given.mapInArrow(_evaluated(model, ranges), EVALUATED), "evaluated")
    tables.dropped()
    discard(counts)
    sent = rows.where("ids is null").select("range", "block", "n", "keys", "numbers", "n_asked", "asked")
    weights = sent.groupBy("range").applyInArrow(_weighed(model), "block long, range long, n long, values binary")
    back = weights.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "n", "values"))).alias("answers"))
    told = rows.where("ids is not null").select("block", "ids", "held_out", "n_tokens", "n_known", "base_score", "score", "n_pairs", "pairs", "times", "counts", "lower", "orders", "n")
    got = told.join(back, "block", "left").mapInArrow(_finished(model), _SCORED)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op13_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
