"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are classes of documents with equal n-gram sets, so copies cost nothing after their class is
known. Columns are n-grams; a column's non-zeros are one block of the product. Only the part of a row that any
partner at the wanted similarity must meet is stored: with the n-grams of a row in one order common to all
rows, two sets with |x & y| >= t |x | y| share an n-gram among the first |x| - ceil(t |x|) + 1 of each. The
order puts frequent n-grams (boilerplate, the text of large groups of copies) last, the most frequent at the very
end, so that blocks stay small. Frequencies are counted over all documents, in about as many cells of the hash as
there are n-grams; a cell's count is an upper bound of its n-grams', and any order that is common to all rows is right.

Only the components that links make are wanted, so the product is taken in two steps:
1. small blocks give all their pairs, and the overlap counts of a pair are summed over its blocks. A pair goes on
   only if that sum and the most that its sizes and places leave outside of the counted part reach the overlap
   that the sizes ask for. A large block pairs its members with its most central one (a star), the one with the
   smallest share of rare n-grams: the original among edited copies. This settles large groups of near copies
   with about as many pairs as members;
2. the large blocks that still hold several components pair members across components only, where the place of
   the shared n-gram in both rows leaves room for the overlap asked for. An edited copy that doesn't link with its
   original has so many n-grams of its own, which come first in the order, that the original's stand too late to
   pass: it meets others through its own n-grams alone.
Pairs are decided on the whole sets, after a bitmap has excluded most that differ too much. Nothing is capped:
the second step is exact.

Hashes: n-grams are 64 bits. A class is its 64-bit digest of the whole set together with nothing else, so two
different sets meet in one class with a chance of about (classes squared) / 2**65.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, stored, table
from .components import components
from .words import U64, WHITE, Words, combine, five, mix, packed, parts, signed, unpacked

WORDS = 5
PERCENT = 75
#: At most so many cells of frequent n-grams, the most frequent, are told to the tasks (12 bytes each). The n-grams of
#: further cells count as rare: the result stays the same, with more pairs to decide.
FREQUENT = 1 << 20
#: A block with at most so many members pairs them all at once; an n-gram of more documents is frequent.
FEW = 8
#: n-grams whose cells are sent as one run, and bits of the cells that are counted in one array.
RUN, RANGE_BITS = 1_000_000, 22
#: Bits of the filter of classes whose whole sets are wanted; full sets pass it by chance at most, none is lost.
FILTER_BITS = 1 << 25
#: Of a stored n-gram's note: thousandths of rare n-grams in its row, the row's size, the n-gram's place in it.
_SIZE_BITS, _PLACE_BITS = 27, 26


def sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the sorted distinct n-gram hashes, end to end, and where each row's begin (one more at the end)."""
    w = Words(batch.column("text"), WHITE, lower=True)
    h = w.hashes()
    grams = five(h)
    found, at = [], [0]
    for lo, hi in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
        if hi - lo >= WORDS:
            one = np.unique(grams[lo : hi - WORDS + 1])
        elif hi > lo:  # the whole sequence is its only n-gram
            one = np.array([hi - lo], dtype=U64)
            for k in range(lo, hi):
                one = combine(one, h[k : k + 1])
        else:
            one = h[:0]
        found.append(one)
        at.append(at[-1] + len(one))
    return np.concatenate(found) if found else np.empty(0, U64), np.array(at)


def digests(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row's set a digest that doesn't depend on the order of its n-grams."""
    sums = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(mix(h), out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U64))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        h, at = sets(batch)
        n = np.diff(at)
        cls = pa.array(digests(h, at).view(np.int64), mask=n == 0)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), cls], ["doc_id", "n", "cls"])


def _fresh(h: np.ndarray, at: np.ndarray, seen: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(class, n-grams) of the rows whose class is new here; seen is what this task has met lately."""
    for k, cls in enumerate(digests(h, at).tolist()):
        if at[k] == at[k + 1] or cls in seen:
            continue
        if len(seen) > 1_000_000:
            seen.clear()
        seen.add(cls)
        yield cls, h[at[k] : at[k + 1]]


def _cells(bits: int, low: int):
    """Sorted cells of the n-grams, in runs, each run cut into the ranges of 2**low cells: (range, n, steps)."""

    def told(kept: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.sort(np.concatenate(kept))
        to = (cells >> U64(low)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        inside = (cells & U64((1 << low) - 1)).astype(np.int64)
        blobs = [packed(np.diff(x, prepend=0)) for x in np.split(inside, first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(to[first]), pa.array(np.diff(np.r_[first, len(to)])), pa.array(blobs, pa.binary())], ["range", "n", "steps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, seen = [], 0, set()
        for batch in parts(batches):
            for _, one in _fresh(*sets(batch), seen):
                kept.append(one >> U64(64 - bits))
                size += len(one)
            if size > RUN:
                yield told(kept)
                kept, size = [], 0
        if size:
            yield told(kept)

    return run


def _counted(low: int):
    """Cells of more than FEW n-grams, from runs that come sorted by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, counts = None, np.zeros(1 << low, dtype=np.uint32)

        def told() -> pa.RecordBatch:
            cells = np.flatnonzero(counts > FEW)
            return pa.RecordBatch.from_arrays([pa.array(cells + (here << low)), pa.array(counts[cells].astype(np.int64))], ["cell", "n"])

        for batch in batches:
            for at, n, steps in zip(batch.column("range").to_pylist(), batch.column("n").to_pylist(), batch.column("steps")):
                if here is not None and at != here:
                    yield told()
                    counts[:] = 0
                here = at
                cells = np.cumsum(unpacked(steps.as_buffer(), n).astype(np.int64))
                first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
                counts[cells[first]] += np.diff(np.r_[first, n]).astype(np.uint32)
        if here is not None:
            yield told()

    return run


def frequent(docs: DataFrame, total: int) -> tuple[int, np.ndarray, np.ndarray]:
    """How many leading bits of a hash make its cell; the cells that go last in the order, sorted, and their ranks by
    frequency. total: about how many n-grams docs have. Copies that a task sees count once. At most FREQUENT cells."""
    bits = min(62, max(20, int(total).bit_length()))
    low = max(min(bits, RANGE_BITS), bits - 16)
    runs = docs.select("text").mapInArrow(_cells(bits, low), "range long, n long, steps binary")
    rows = (
        runs.repartition("range")
        .sortWithinPartitions("range")
        .mapInArrow(_counted(low), "cell long, n long")
        .orderBy(F.desc("n"), "cell")
        .limit(FREQUENT)
        .toPandas()
    )
    cells = rows["cell"].to_numpy(np.int64).astype(U64)
    by = np.argsort(cells)
    return bits, cells[by], (len(cells) - np.arange(len(cells), dtype=np.int32))[by]


def _late(one: np.ndarray, order: tuple[int, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which of a row's sorted n-grams go last, and the ranks of those."""
    bits, last, rank = order
    if not len(last):
        return np.zeros(len(one), dtype=bool), rank
    cells = one >> U64(64 - bits)
    place = np.searchsorted(last, cells)
    place[place == len(last)] = 0
    late = last[place] == cells
    return late, rank[place[late]]


def reach(n: int, percent: int) -> int:
    """How many of a row's n n-grams any partner must meet."""
    return n - (percent * n + 99) // 100 + 1


def prefix(one: np.ndarray, order: tuple[int, np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, int]:
    """The first n-grams of a row (sorted by hash) in the common order, and the thousandths of rare ones in the row."""
    k = reach(len(one), percent)
    late, rank = _late(one, order)
    if not len(rank):
        return one[:k], 1000
    rare = one[~late]
    share = 1000 * len(rare) // len(one)
    if len(rare) >= k:
        return rare[:k], share
    return np.concatenate([rare, one[late][np.argsort(rank, kind="stable")][: k - len(rare)]]), share


def _index(order, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in parts(batches):
            hs, cs, ps = [], [], []
            for cls, one in _fresh(*sets(batch), seen):
                first, share = prefix(one, order.value, percent)
                hs.append(first)
                cs.append(np.full(len(first), cls, dtype=U64))
                ps.append(((share << _SIZE_BITS | len(one)) << _PLACE_BITS) + np.arange(len(first), dtype=np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(hs)), signed(np.concatenate(cs)), pa.array(np.concatenate(ps))], ["h", "cls", "note"])

    return run


class _Blocks:
    """Pairs and members of the blocks in a partition that is sorted by (h, note, cls), as rows (h, a, b, x, y): of small
    blocks (h null) two classes and their notes; of large ones each class, its centre and their notes.

    Rows come in batches and a block may cross them, so of the block at a batch's end either its few rows are held
    back or, once it is large, only its first row, the centre.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.held = np.empty((3, 0), dtype=np.int64)  # h, note, cls of an unfinished small block
        self.large = None  # the first row of an unfinished large block
        self.last = None

    def _pairs(self, rows: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
        """(cls, other cls, note, other note) of the pairs whose sizes allow the similarity."""
        i, j = np.triu_indices(k, 1)
        at, to = (starts[:, None] + i).ravel(), (starts[:, None] + j).ravel()
        n, m = _size(rows[1, at]), _size(rows[1, to])
        good = 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
        at, to = at[good], to[good]
        turn = rows[2, at] > rows[2, to]
        at, to = np.where(turn, to, at), np.where(turn, at, to)
        return np.stack([rows[2, at], rows[2, to], rows[1, at], rows[1, to]])

    def add(self, rows: np.ndarray | None) -> pa.RecordBatch | None:
        """What is certain after these rows; None stands for the end."""
        end = rows is None
        rows = self.held if end else np.concatenate([self.held, rows], axis=1)
        if rows.shape[1]:  # a class that several tasks have seen comes several times
            again = np.r_[False, (rows[:, 1:] == rows[:, :-1]).all(axis=0)]
            if self.last is not None:
                again[0] = bool((rows[:, 0] == self.last).all())
            rows = rows[:, ~again]
        h = rows[0]
        pairs, many, leads = [], [], []
        first = 0
        if self.large is not None and len(h):
            same = h == self.large[0]
            first = len(h) if same.all() else int(np.argmin(same))
            many.append(rows[:, :first])
            leads.append(np.repeat(self.large[:, None], first, axis=1))
            if first < len(h):
                self.large = None
        self.last = rows[:, -1].copy() if len(h) and not end else self.last
        rows = rows[:, first:]
        h = rows[0]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
        sizes = np.diff(np.r_[starts, len(h)])
        self.held = rows[:, :0]
        if len(starts) and not end:
            at = starts[-1]
            if sizes[-1] <= FEW:
                self.held, self.last = rows[:, at:].copy(), rows[:, at - 1].copy() if at else None
                starts, sizes = starts[:-1], sizes[:-1]
            else:
                self.large = rows[:, at].copy()
        for k in range(2, FEW + 1):
            some = starts[sizes == k]
            if len(some):
                pairs.append(self._pairs(rows, some, k))
        big = sizes > FEW
        if big.any():
            inside = np.repeat(big, sizes)
            whole = rows[:, : len(inside)]
            many.append(whole[:, inside])
            leads.append(np.repeat(whole[:, starts[big]], sizes[big], axis=1))
        if not pairs and not many:
            return None
        p = np.concatenate(pairs, axis=1) if pairs else np.empty((4, 0), np.int64)
        m = np.concatenate(many, axis=1) if many else np.empty((3, 0), np.int64)
        lead = np.concatenate(leads, axis=1) if leads else m
        h = pa.concat_arrays([pa.nulls(p.shape[1], pa.int64()), pa.array(m[0])])
        both = np.concatenate([p, np.stack([m[2], lead[2], m[1], lead[1]])], axis=1)
        both[2:] &= (1 << _SIZE_BITS + _PLACE_BITS) - 1
        return pa.RecordBatch.from_arrays([h, *map(pa.array, both)], ["h", "a", "b", "x", "y"])


def _size(note: np.ndarray) -> np.ndarray:
    return (note >> _PLACE_BITS) & ((1 << _SIZE_BITS) - 1)


def _multiply(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(percent)
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in ("h", "note", "cls")])
            if rows.shape[1] and (got := blocks.add(rows)) is not None:
                yield got
        if (got := blocks.add(None)) is not None:
            yield got

    return run


def _wanted(classes: DataFrame) -> np.ndarray:
    """A bit filter of the classes: FILTER_BITS bits, whatever their number."""
    words = (
        classes.selectExpr(f"pmod(cls, {FILTER_BITS}L) as place")
        .selectExpr("cast(shiftright(place, 5) as int) as w", "shiftleft(1L, cast(place % 32 as int)) as b")
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    bits = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return bits


def signature(one: np.ndarray) -> np.ndarray:
    """A bitmap with a bit flipped for each n-gram, of about two bits an n-gram. Two sets differ in at least as
    many n-grams as their bitmaps do in bits (the longer bitmap folded onto the shorter)."""
    size = 1 << max(6, int(2 * len(one) - 1).bit_length())
    odd = np.bincount((one & U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8))


def far_apart(x: np.ndarray, y: np.ndarray, p: int, q: int, percent: int) -> bool:
    """Whether the bitmaps of sets of sizes p and q prove them less similar than percent."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    differ = int(np.bitwise_count(x ^ y).sum())
    # |x ^ y| >= differ, so 2 |x & y| <= p + q - differ
    return 2 * percent * (p + q) > (100 + percent) * (p + q - differ)


def _near(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [
                not far_apart(np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8), p, q, percent)
                for a, b, p, q in zip(x, y, batch.column("p").to_pylist(), batch.column("q").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _whole(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in parts(batches):
            ids, signs, blobs = [], [], []
            for cls, one in _fresh(*sets(batch), seen):
                place = (cls - (cls >> 63 << 64)) % FILTER_BITS
                if bits.value[place >> 5] >> (place & 31) & 1:
                    ids.append(cls)
                    signs.append(signature(one).tobytes())
                    blobs.append(one.tobytes())
            if ids:
                sizes = pa.array([len(x) // 8 for x in blobs], pa.int64())
                yield pa.RecordBatch.from_arrays([signed(np.array(ids, U64)), sizes, pa.array(signs, pa.binary()), pa.array(blobs, pa.binary())], ["cls", "n", "sign", "blob"])

    return run


def _decide(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                place = np.searchsorted(q, p)
                place[place == len(q)] = 0
                both = int((q[place] == p).sum())
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def linked(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are similar enough, decided on their whole sets; checkpointed."""
    classes = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(_wanted(classes))
    whole = docs.select("text").mapInArrow(_whole(bits), "cls long, n long, sign binary, blob binary")
    # a class that several tasks have seen comes several times, with one content
    whole = stored(whole.join(classes, "cls", "left_semi").dropDuplicates(["cls"]), "sets")
    near = stored(
        pairs.join(whole.select(F.col("cls").alias("a"), F.col("n").alias("p"), F.col("sign").alias("x")), "a")
        .join(whole.select(F.col("cls").alias("b"), F.col("n").alias("q"), F.col("sign").alias("y")), "b")
        .select("a", "b", "p", "q", "x", "y")
        .mapInArrow(_near(percent), "a long, b long"),
        "near",
    )
    got = cut(
        near.join(whole.select(F.col("cls").alias("a"), F.col("blob").alias("x")), "a")
        .join(whole.select(F.col("cls").alias("b"), F.col("blob").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_decide(percent), "a long, b long")
    )
    discard(whole, near)
    return got


def _sized(note: str) -> str:
    return f"shiftright({note}, {_PLACE_BITS})"


def _placed(note: str) -> str:
    return f"({note} & {(1 << _PLACE_BITS) - 1})"


def accumulated(small: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the small blocks that can still have the overlap their sizes ask for.

    A pair's common n-grams are those counted here, at most as many as the row with fewer has in large blocks
    (held: cls, large), and those that aren't among the counted part of one of the two rows. The last kind comes
    after all others in the common order, so it is no more than what either row has after its last counted place,
    and no more than one of the rows has outside of its counted part.
    """
    both = F.ceil((F.col("n") + F.col("m")) * percent / F.lit(100 + percent))
    rest = lambda n: F.ceil(F.col(n) * percent / F.lit(100)) - 1
    beyond = F.greatest(F.least(rest("n"), F.expr("m - q - 1")), F.least(rest("m"), F.expr("n - p - 1")))
    return (
        small.groupBy("a", "b")
        .agg(F.count("*").alias("c"), *(F.max(F.expr(e)).alias(k) for k, e in (("n", _sized("x")), ("m", _sized("y")), ("p", _placed("x")), ("q", _placed("y")))))
        .join(held.select(F.col("cls").alias("a"), F.col("large").alias("i")), "a", "left")
        .join(held.select(F.col("cls").alias("b"), F.col("large").alias("j")), "b", "left")
        .where(F.col("c") + F.least(F.coalesce("i", F.lit(0)), F.coalesce("j", F.lit(0))) + beyond >= both)
        .select("a", "b")
    )


def similar_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, n_shingles long, component_id long), a row for each row.

    Sets: distinct 5-word n-grams of the lower-cased (A-Z) text; with fewer words, the whole sequence. Two rows
    link when 100 * intersection >= percent * union. component_id is the smallest doc_id that links reach.
    A null or empty text, or one without words, has no n-grams and links with nothing. Repeated rows are in one
    component. A null doc_id is never the component's id unless no other is there. Further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    members = stored(docs.mapInArrow(_members, "doc_id long, n long, cls long"), "members")
    sizes = members.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))

    order = spark.sparkContext.broadcast(frequent(docs, members.agg(F.sum("n")).first()[0] or 0))
    index = docs.select("text").mapInArrow(_index(order, percent), "h long, cls long, note long")
    # the first of a block is its centre: the least rare n-grams, then the smallest
    index = index.repartition("h").sortWithinPartitions("h", "note", "cls")
    found = stored(index.mapInArrow(_multiply(percent), "h long, a long, b long, x long, y long"), "blocks")
    many = found.where("h is not null").selectExpr("h", "a as cls", "b as lead", f"{_sized('x')} as n", f"{_placed('x')} as pos", f"{_sized('y')} as lead_n")
    stars = (
        many.where(f"cls <> lead and 100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)")
        .groupBy(F.col("cls").alias("a"), F.col("lead").alias("b"))
        .agg(F.count("*").alias("c"), F.first("n").alias("n"))
        # a star counts only blocks that its centre leads; where few do, step 2 decides
        .where("20 * c >= n or c >= 20")
        .select("a", "b")
    )
    small = accumulated(found.where("h is null"), many.groupBy("cls").agg(F.count("*").alias("large")), percent)
    first = linked(docs, cut(small.union(stars).distinct()), percent)
    roots = components(first)

    held = many.join(roots, many["cls"] == roots["v"], "left").select("h", "cls", "pos", "n", F.coalesce("root", "cls").alias("root"))
    mixed = held.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("h")
    held = cut(held.join(mixed, "h", "left_semi").distinct())
    # both hold at least so many n-grams in common, so the first common one is at most so far into either
    both = f"ceil({percent} * (x.n + y.n) / (100 + {percent}))"
    meet = f"x.h = y.h and x.cls < y.cls and x.pos <= x.n - {both} and y.pos <= y.n - {both}"
    across = held.alias("x").join(held.alias("y"), F.expr(f"{meet} and x.root <> y.root"))
    across = cut(across.selectExpr("x.cls as a", "y.cls as b").distinct())
    discard(found)
    least = sizes.join(roots, sizes["cls"] == roots["v"], "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    if not across.isEmpty():
        # what the second step links are components of the first, so only their roots meet
        more, one = linked(docs, across, percent), least.select("cls", "root")
        more = more.join(one.select(F.col("cls").alias("a"), F.col("root").alias("x")), "a").join(one.select(F.col("cls").alias("b"), F.col("root").alias("y")), "b")
        tops = components(more.select(F.col("x").alias("a"), F.col("y").alias("b")))
        least = least.join(tops.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left").select("cls", "least", F.coalesce("top", "root").alias("root"))
    least = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    some, none = members.where("cls is not null"), members.where("cls is null")
    some = some.join(least, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(none.select("doc_id", F.col("n"), "doc_id"))


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


#: Sets, links and reachability in DuckDB.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS v, doc_id AS u FROM documents
  UNION
  SELECT r.v, e.b FROM r JOIN e ON e.a = r.u
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.u AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(u) AS u FROM r GROUP BY v) m ON m.v = d.doc_id
"""
