"""Words of Arrow string columns, found and hashed with numpy over the UTF-8 bytes of many rows at once.

A word is a run of bytes outside a set of ASCII separators, so no row is decoded and no Python string is made.
Hashes are 64 bits: a polynomial over the bytes (prefix sums modulo 2**64), then a bit mixer. Sequences of
words are hashed by combining the hashes of their halves, so a window of 2k words costs one step more than
its two windows of k words.
"""

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
#: Bytes of text handled at once; bounds the memory of the arrays made from it (about 60 bytes a byte).
SLICE_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence that a hashes followed by the one that b hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + ((b << U64(23)) | (b >> U64(41))) + U64(0x632BE59BD9B4E019))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, below n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            both = []
            for base in (_BASE, _INVERSE):
                run = np.full(size, base, dtype=U64)
                run[0] = 1
                both.append(np.multiply.accumulate(run))
        _powers = both[0], both[1]
    return _powers


def separators(codes: list[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[codes] = True
    return table


#: Complement of [^\x20\x09-\x0D]+
WHITE = separators([0x20, *range(0x09, 0x0E)])
#: Complement of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z have been lower-cased)
PUNCTUATION = separators([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


class Words:
    """Words of some rows. word i of row r is at ptr[r] + i; starts and ends are byte places in buf."""

    def __init__(self, texts: pa.Array, separator: np.ndarray, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
        buf = whole[offsets[0] : offsets[-1]]
        self.buf = _LOWER[buf] if lower else buf
        self.offsets = offsets - offsets[0]
        inside = ~separator[self.buf]
        before = np.empty_like(inside)
        before[1:], before[:1] = inside[:-1], False
        before[self.offsets[:-1][self.offsets[:-1] < len(buf)]] = False
        after = np.empty_like(inside)
        after[:-1], after[-1:] = inside[1:], False
        after[self.offsets[1:][self.offsets[1:] > 0] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.ptr = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        power, inverse = _powers_to(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, dtype=U64)
        np.cumsum(_BYTE[self.buf] * power[: len(self.buf)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(U64))


def double(h: np.ndarray, k: int) -> np.ndarray:
    """From hashes of the windows of k words at every place, those of 2k words."""
    return combine(h[:-k], h[k:]) if len(h) > k else h[:0]


def five(w: np.ndarray) -> np.ndarray:
    """Hashes of all windows of 5 words, across row ends too."""
    if len(w) < 5:
        return w[:0]
    four = double(double(w, 1), 2)
    return combine(four[: len(w) - 4], w[4:])


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of texts with about `most` bytes each; a longer row is alone."""
    sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield lo, hi
        lo = hi


def parts(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into slices by the size of their texts. Workers are used again by later tasks, so what a task has
    freed goes back to the system."""
    _large_apart()
    try:
        for batch in batches:
            for lo, hi in slices(batch.column(batch.schema.get_field_index(text))):
                yield batch.slice(lo, hi - lo)
    finally:
        pa.default_memory_pool().release_unused()
        _asked("malloc_trim", 0)


def _asked(name: str, *args: int) -> None:
    """Calls the C library's function where it has one of that name (glibc does)."""
    if (call := getattr(ctypes.CDLL(None), name, None)) is not None:
        call(*args)


@functools.cache
def _large_apart() -> None:
    """Arrays of a megabyte or more are mapped by themselves (M_MMAP_THRESHOLD), and so are given back when freed."""
    _asked("mallopt", -3, 1 << 20)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def packed(x: np.ndarray) -> bytes:
    """uint32 numbers compressed, their low bytes first, then the next, so that small ones take little."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
