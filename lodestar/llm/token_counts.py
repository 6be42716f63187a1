"""Token counts of a byte-level BPE vocabulary without materialising ids.

The library splits a text into pre-tokens by a pattern and merges bytes inside each, so the count of a text is
the sum over its pre-tokens of a number that depends on the pre-token alone. Each pre-token is therefore encoded
once: documents give their pre-token frequencies, distinct pre-tokens are counted, and the two are joined.

To keep the join small the frequencies are stored by block: some megabytes of documents share one list of
distinct pre-tokens, ordered by hash, and hold (place in the list, frequency) pairs. A block sends each hash
bucket its share of the list and gets one byte-string of counts back, so a pre-token crosses the shuffle once
for each block that has it and not once for each document.
"""

import functools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table
from .words import U64, _BYTE, _powers_to, mix, packed, signed, unpacked

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Bytes of text in a block.
BLOCK_BYTES = 16 << 20
#: Distinct pre-tokens counted in one task, about, and the least number of such tasks. A block sends no more shares than
#: there are buckets, and these grow with the vocabulary of the corpus, not with its blocks.
BUCKET_PIECES, LEAST_BUCKETS = 50_000, 48


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def _splitter(path: str):
    """Text -> its pre-tokens, as the library splits it.

    The pattern is run by `regex`, which may know letters and digits of a later Unicode version than the library
    does. Those are found once by asking the library, and it splits texts that hold one itself.
    """
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    odd = []
    for kind, before in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        known = regex.findall(kind, every)
        one = {(" " + before + x) for x in known}
        text = "".join(sorted(one))
        one -= {text[a:b] for _, (a, b) in library(text)}
        odd += [x[-1] for x in one]
    split = regex.compile(_pattern()).findall
    if not odd:
        return split
    points = sorted(map(ord, odd))
    runs = [[points[0], points[0]]]
    for c in points[1:]:
        if c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    newer = re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]").search
    return lambda text: [text[a:b] for _, (a, b) in library(text)] if newer(text) else split(text)


def _specials(path: str) -> list[str]:
    """Strings that the library's default takes for one token wherever they stand in a text, longest first."""
    with open(path, encoding="utf-8") as f:
        return sorted((x["content"] for x in json.load(f)["added_tokens"]), key=len, reverse=True)


def piece_hashes(pieces: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    pieces = pieces.cast(pa.large_string())
    offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = pieces.buffers()[2]
    buf = (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    power, inverse = _powers_to(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]] + np.diff(offsets).astype(U64))


_BLOCK = "block long, ids array<long>, sizes array<long>, extra array<long>, ptr binary, place binary, times binary, pieces array<string>, n_pairs long"


def _blocks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        specials = _specials(path)
        split = _splitter(path)
        cut = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        part, count = TaskContext.get().partitionId(), 0
        ids, sizes, extra, ptr, place, times, known = [], [], [], [0], [], [], {}

        def block() -> pa.RecordBatch:
            nonlocal count
            pieces = pa.array(list(known), pa.string())
            h = piece_hashes(pieces)
            order = np.argsort(h, kind="stable")
            to = np.empty(len(order), dtype=np.uint32)
            to[order] = np.arange(len(order), dtype=np.uint32)
            at = np.array(ptr, np.uint32)
            # each document's places ascend, so that their differences (over the whole block, modulo 2**32) are small
            keys = np.repeat(np.arange(len(ids), dtype=np.uint64) << np.uint64(32), np.diff(at)) | to[np.concatenate(place)]
            by = np.argsort(keys, kind="stable")
            steps = np.diff(keys[by].astype(np.uint32), prepend=np.uint32(0))
            row = [[part << 33 | count], [ids], [sizes], [extra], [packed(at)], [packed(steps)], [packed(np.concatenate(times)[by])]]
            count += 1
            types = [pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 3]
            arrays = [pa.array(x, t) for x, t in zip(row, types)]
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces.take(pa.array(order))))
            arrays.append(pa.array([ptr[-1]], pa.int64()))
            return pa.RecordBatch.from_arrays(arrays, ["block", "ids", "sizes", "extra", "ptr", "place", "times", "pieces", "n_pairs"])

        held = 0
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = value.as_py() or ""
                n_bytes = value.as_buffer().size if value.is_valid else 0
                spans, more = [text], 0
                if cut is not None and any(s in text for s in specials):
                    spans = cut.split(text)
                    more = len(spans) - 1
                found = Counter(split(spans[0]))
                for x in spans[1:]:
                    found.update(split(x))
                ids.append(doc_id)
                sizes.append(n_bytes)
                extra.append(more)
                place.append(np.fromiter((known.setdefault(x, len(known)) for x in found), dtype=np.uint32, count=len(found)))
                times.append(np.fromiter(found.values(), dtype=np.uint32, count=len(found)))
                ptr.append(ptr[-1] + len(found))
                held += n_bytes
                if held >= BLOCK_BYTES:
                    yield block()
                    ids, sizes, extra, ptr, place, times, known = [], [], [], [0], [], [], {}
                    held = 0
        if ids:
            yield block()

    return run


def _shares(buckets: int):
    """Of each block's list the part of each bucket; buckets are ranges of the hash, so parts are in list order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pieces in zip(batch.column("block"), batch.column("pieces")):
                values = pieces.values
                to = (piece_hashes(values) >> U64(40)).astype(np.int64) * buckets >> 24
                first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, np.int64)
                if not len(first):
                    continue
                shares = pa.ListArray.from_arrays(pa.array(np.r_[first, len(to)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array(to[first]), pa.array([block.as_py()] * len(first), pa.int64()), shares], ["bucket", "block", "pieces"])

    return run


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _count(path: str):
    """Counts of the pieces of shares that come in order of their buckets. Of a bucket the distinct pieces are held with
    their counts, and one batch of shares, however many blocks have some of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, of, known = _tokenizer(path), None, {}
        for batch in batches:
            buckets = np.asarray(batch.column("bucket"))
            ends = np.flatnonzero(np.r_[buckets[1:] != buckets[:-1], True]) + 1 if len(buckets) else []
            for lo, hi in zip(np.r_[0, ends[:-1]] if len(buckets) else [], ends):
                part = batch.slice(lo, hi - lo)
                if buckets[lo] != of:
                    of, known = buckets[lo], {}
                lists = part.column("pieces")
                pieces = lists.flatten().dictionary_encode()
                distinct = pieces.dictionary.to_pylist()
                new = [x for x in distinct if x not in known]
                for k in range(0, len(new), 1024):
                    some = new[k : k + 1024]
                    known.update(zip(some, map(len, tokenizer.encode_batch(some, add_special_tokens=False))))
                n = np.fromiter((known[x] for x in distinct), dtype=np.uint32, count=len(distinct))
                counts = n[pieces.indices.to_numpy()]
                at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                blobs = [counts[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("block"), part.column("bucket"), pa.array(blobs, pa.binary())], ["block", "bucket", "counts"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            counts = np.concatenate([np.frombuffer(x["counts"], np.uint32) for x in row["shares"]]) if row["shares"] else np.empty(0, np.uint32)
            ptr, steps, times = unpacked(row["ptr"], len(row["ids"]) + 1), unpacked(row["place"], row["n_pairs"]), unpacked(row["times"], row["n_pairs"])
            place = np.cumsum(steps, dtype=np.uint32)
            each = np.concatenate([[0], np.cumsum(counts[place].astype(np.int64) * times)])
            n = each[ptr[1:]] - each[ptr[:-1]] + np.array(row["extra"], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, n_bytes long, n_tokens long), a row for each row.

    n_tokens is what the library gives for the whole text without begin, end or added special tokens; special
    strings inside a text are one token each, its default. A null or empty text has 0 bytes and tokens. Repeated
    rows and null ids are counted like others. Further columns are ignored. No rows: no rows.
    """
    path = path or vocabulary_path()
    blocks = stored(docs.select("doc_id", "text").mapInArrow(_blocks(path), _BLOCK), "pretokens")
    distinct = blocks.select(F.explode("pieces").alias("piece")).agg(F.approx_count_distinct("piece")).first()[0]
    buckets = min(1 << 20, max(LEAST_BUCKETS, distinct // BUCKET_PIECES))
    shares = blocks.select("block", "pieces").mapInArrow(_shares(buckets), "bucket long, block long, pieces array<string>")
    ordered = shares.repartition("bucket").sortWithinPartitions("bucket", "block")
    counted = ordered.mapInArrow(_count(path), "block long, bucket long, counts binary")
    back = counted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "counts"))).alias("shares"))
    # a block without pre-tokens has no shares
    return blocks.drop("pieces").join(back, "block", "left").mapInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
