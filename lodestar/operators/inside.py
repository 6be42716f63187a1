"""Which asked strings stand in texts, for many strings and many texts at once.

An asked string of letters, digits, _ and - lies in one run of such characters. So each distinct run of a batch of texts is
looked up once, by its own pieces of the lengths that are asked, and what is left is arithmetic on numbers of texts, runs
and strings. A text costs its runs, not the strings that are asked.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that an asked string may be made of, and the runs of a text.
RUN = r"[\p{L}\p{N}_-]+"
#: Texts, queries and strings that meet at once, runs that a task remembers.
TEXTS, ASKED, STRINGS, KNOWN = 512, 2048, 1 << 16, 1 << 18


def plain(text: Column) -> Column:
    return text.rlike(rf"^{RUN}$")


def _pieces(run: str, strings: dict[str, int], lengths: list[int]) -> list[int]:
    """Numbers of the strings that stand in a run."""
    found = {strings.get(run[a : a + n], -1) for n in lengths for a in range(len(run) - n + 1)}
    found.discard(-1)
    return list(found)


class Lookup:
    """The numbers of strings inside runs, remembered for runs seen before; `whole` are told by whole runs only."""

    def __init__(self, inside: dict[str, int], whole: dict[str, int]):
        self.inside, self.whole, self.lengths, self.known = inside, whole, sorted({len(s) for s in inside}), {}

    def of(self, run: str) -> np.ndarray:
        got = self.known.get(run)
        if got is None:
            found = _pieces(run, self.inside, self.lengths)
            if self.whole:
                found += [self.whole[w] for w in run.split("-") if w in self.whole]
            if len(self.known) >= KNOWN:
                self.known.clear()
            got = self.known[run] = np.array(found, dtype=np.int64)
        return got

    def met(self, runs: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(text, string), each pair once, of a list of runs for each text."""
        words = runs.flatten().dictionary_encode()
        hits = [self.of(w) for w in words.dictionary.to_pylist()]
        size = np.array([len(h) for h in hits], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        every = np.concatenate([np.empty(0, np.int64), *hits])
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        text = np.repeat(np.arange(len(runs)), _sizes(runs))
        at, n = spread(begin[codes], size[codes])
        most = len(self.inside) + len(self.whole) + 1
        pair = np.unique(np.repeat(text, n) * most + every[at])
        return pair // most, pair % most


def spread(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places begin .. begin + size - 1 of each row, end to end; and the sizes."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size), size


def _one(x: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)


def _sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _met(texts: DataFrame, asked: DataFrame, most: int, out: str, prepared: Callable) -> DataFrame:
    """prepared(a block of asked rows) gives what to do with (ids, runs) of some texts. Asked rows are packed by a hash to
    blocks of about `most`, texts in parts of TEXTS, and every pair of a block and a part meets once."""
    n = max(1, -(-asked.count() // most))
    every = F.struct(*asked.columns)
    blocks = asked.groupBy(F.pmod(F.xxhash64(asked.columns[0]), F.lit(n)).alias("block")).agg(F.collect_list(every).alias("asked"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                yield pa.RecordBatch.from_arrays([_one(part.column("id")), _one(part.column("runs"))], ["ids", "runs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = work = None
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column("block")[k].as_py() != last:
                    last, work = batch.column("block")[k].as_py(), prepared(batch.column("asked")[k].values)
                yield work(batch.column("ids")[k].values, batch.column("runs")[k].values)

    runs = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(RUN), F.lit(0)))
    parts = texts.where("text is not null").select("id", runs.alias("runs")).mapInArrow(packed, f"ids array<{dict(texts.dtypes)['id']}>, runs array<array<string>>")
    return parts.join(blocks.hint("shuffle_replicate_nl")).mapInArrow(meet, out)


def holding(texts: DataFrame, queries: DataFrame, share: float) -> DataFrame:
    """(query_id, id, hits): texts (id, text) that hold that share of the strings of a query (query_id, terms) at least,
    and one of them. Terms are distinct, lower-case and plain()."""

    def prepared(block: pa.StructArray) -> Callable:
        lists = block.field("terms")
        words = lists.flatten().dictionary_encode()
        look = Lookup({w: i for i, w in enumerate(words.dictionary.to_pylist())}, {})
        codes = words.indices.to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(block)), _sizes(lists))[np.argsort(codes, kind="stable")]  # queries, string by string
        size = np.bincount(codes, minlength=len(words.dictionary))
        begin, need = np.cumsum(size) - size, np.maximum(1, np.ceil(_sizes(lists) * share))

        def work(ids: pa.Array, runs: pa.ListArray) -> pa.RecordBatch:
            text, string = look.met(runs)
            at, n = spread(begin[string], size[string])
            hits = np.bincount(np.repeat(text, n) * len(need) + of[at], minlength=len(ids) * len(need)).reshape(len(ids), len(need))
            text, query = np.nonzero(hits >= need)
            return pa.RecordBatch.from_arrays([block.field("query_id").take(pa.array(query)), ids.take(pa.array(text)), pa.array(hits[text, query].astype(np.int64))], ["query_id", "id", "hits"])

        return work

    types = dict(texts.dtypes) | dict(queries.dtypes)
    asked = queries.where(F.size("terms") > 0).select("query_id", "terms")
    return _met(texts, asked, ASKED, f"query_id {types['query_id']}, id {types['id']}, hits long", prepared)


def counted(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """(part, whole, df): in how many of the texts (id, text) each string (part, whole) stands; whole ones only as a whole
    word, between hyphens. Strings are distinct, lower-case and plain(); those in no text have no row."""

    def prepared(block: pa.StructArray) -> Callable:
        part, whole = block.field("part").to_pylist(), block.field("whole").to_pylist()
        look = Lookup({s: i for i, s in enumerate(part) if not whole[i]}, {s: i for i, s in enumerate(part) if whole[i]})

        def work(ids: pa.Array, runs: pa.ListArray) -> pa.RecordBatch:
            n = np.bincount(look.met(runs)[1], minlength=len(part))
            some = np.nonzero(n)[0]
            return pa.RecordBatch.from_arrays([block.field(c).take(pa.array(some)) for c in ("part", "whole")] + [pa.array(n[some].astype(np.int64))], ["part", "whole", "n"])

        return work

    asked = strings.select("part", "whole")
    return _met(texts, asked, STRINGS, "part string, whole boolean, n long", prepared).groupBy("part", "whole").agg(F.sum("n").alias("df"))
