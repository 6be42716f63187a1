"""What a question asks beyond its own words: other forms of a word, other names, corrected spelling; and where a text
answers it."""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stems import stems
from ..functions.text import TOKEN
from ..lineage import cut, cut_as_dealt
from . import inside
from .retrieval import small_batches, told

LONGEST_PREFIX = 24


def stem_forms(vocabulary: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forms, queries): words of the vocabulary (term) with the stem that queries (query_id, terms) ask for, and the
    queries by stems. Pass both to retrieval.bm25(). The vocabulary is gone through once, and only words with an asked stem
    are kept."""
    asked = queries.select("query_id", F.explode("terms").alias("term"))
    own = cut(stems(asked))
    by_stem = cut(asked.join(own, "term").groupBy("query_id").agg(F.collect_set("form").alias("terms")))
    known = stems(vocabulary.select("term").union(own.select("term")))
    return cut(known.join(told(own.select("form").distinct()), "form", "left_semi").select("term", "form")), by_stem


def prefix_forms(vocabulary: DataFrame, queries: DataFrame) -> DataFrame:
    """(term, form): words of the vocabulary (term) and the asked terms that they begin with. Asked terms longer than
    LONGEST_PREFIX meet words by that many letters first."""
    asked = queries.select(F.explode("terms").alias("form")).distinct().withColumn("begin", F.left("form", F.lit(LONGEST_PREFIX)))
    parts = vocabulary.select("term", F.explode(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(LONGEST_PREFIX)))).alias("n")).select("term", F.left("term", F.col("n")).alias("begin"))
    return parts.join(asked, "begin").where(F.startswith("term", "form")).select("term", "form").distinct()


def distance(a: str, b: str, most: int) -> int:
    """Edits between two words, swapped neighbours as one; most + 1 where there are more."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            n = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                n = min(n, rows[-2][j - 2] + 1)
            row.append(n)
        if min(row) > most:
            return most + 1
        rows.append(row)
    return min(rows[-1][-1], most + 1)


def corrections(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, correction, dist) of asked words (term) that the vocabulary (term, df) doesn't hold.

    Only words of five letters or more without a digit. Candidates stand in two texts or more, begin alike and are at
    most 1 edit away, 2 for words over 8 letters; nearer ones first, then frequent ones, then by the alphabet.
    """
    most = F.when(F.length("term") <= 8, 1).otherwise(2)
    unknown = asked.select("term").distinct().where((F.length("term") >= 5) & ~F.col("term").rlike("[0-9]")).join(vocabulary.select("term"), "term", "left_anti")
    unknown = unknown.select("term", most.alias("most"), F.left("term", F.lit(1)).alias("first"), F.explode(F.sequence(F.length("term") - most, F.length("term") + most)).alias("size"))
    known = vocabulary.where("df >= 2").select(F.col("term").alias("word"), "df", F.left("term", F.lit(1)).alias("first"), F.length("term").alias("size"))
    # a swap is two plain edits
    near = unknown.join(known, ["first", "size"]).where(F.levenshtein("term", "word") <= 2 * F.col("most")).select("term", "word", "df", "most")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["dist"] = [distance(a, b, int(n)) for a, b, n in zip(x["term"], x["word"], x["most"])]
            yield x

    close = near.mapInPandas(run, "term string, word string, df long, most int, dist int").where("dist <= most")
    score = (F.col("most") - F.col("dist") + 1) * 1000 + F.col("df")
    best = close.groupBy("term").agg(F.min_by(F.struct("word", "dist"), F.struct(-score, F.col("word"))).alias("b"))
    return best.select("term", F.col("b.word").alias("correction"), F.col("b.dist").alias("dist"))


def expanded(queries: DataFrame, aliases: dict[str, str], fixed: DataFrame, readable: DataFrame) -> DataFrame:
    """queries (query_id, text, terms) with more terms: what aliases say for a term, or for several words that the text
    holds, and the corrections (term, correction) that a readable text has (readable: term). The asked terms stay."""
    low = F.lower("text")
    one = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else F.create_map().cast("map<string,string>")
    more = F.flatten(F.transform("terms", lambda t: F.split(F.coalesce(F.try_element_at(one, t), F.lit("")), " ")))
    for words, other in aliases.items():
        if " " in words:
            more = F.concat(more, F.when(low.contains(words), F.split(F.lit(other), " ")).otherwise(F.array().cast("array<string>")))
    good = fixed.join(readable.select(F.col("term").alias("correction")).distinct(), "correction", "left_semi")
    mended = queries.select("query_id", F.posexplode("terms").alias("pos", "term")).join(good, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "correction"))).alias("m"))
    rows = queries.join(mended, "query_id", "left")
    every = F.concat("terms", F.filter(more, lambda x: x != ""), F.coalesce(F.transform("m", lambda x: x["correction"]), F.array().cast("array<string>")))
    return rows.select("query_id", "text", F.array_distinct(every).alias("terms"))


# Points of a stretch for each kind of term in it, each further word of one, and for beginning where a sentence
# or the text does.
KIND, AGAIN, SENTENCE, BEGIN = 1000, 1, 100, 120
_WORDS, _ENDED = re.compile(r"[^\W_]+"), re.compile(r"[.:][ \t\r\n]+\Z")


def _best_stretch(at: list[int], kinds: list[str], sentences: list[int], n: int, size: int) -> int:
    """Where the best stretch of a text of n words begins. at: places of the asked words, in order; kinds: what they are.

    Stretches begin at an asked word, and are moved so that what they hold is in their middle, or at the sentence that
    an asked word stands in. Each end of a stretch moves forward only, so a text costs as much as it has asked words.
    """

    def scored(starts: list[int]) -> list[tuple[int, int]]:
        """For ascending starts the points of the asked words in size words from there, and the index of the last of them."""
        out, lo, hi, inside = [], 0, 0, Counter()
        for start in starts:
            while hi < len(at) and at[hi] < start + size:
                inside[kinds[hi]] += 1
                hi += 1
            while lo < hi and at[lo] < start:
                inside[kinds[lo]] -= 1
                if not inside[kinds[lo]]:
                    del inside[kinds[lo]]
                lo += 1
            out.append((KIND * len(inside) + AGAIN * (hi - lo - len(inside)), hi - 1))
        return out

    own = scored(at)
    begins, s = [], 0
    for k in at:
        while s + 1 < len(sentences) and sentences[s + 1] <= k:
            s += 1
        begins.append(sentences[s])
    of_sentence = scored(begins)
    best, found = -1, 0
    for k, (points, last), begin, (more, _) in zip(at, own, begins, of_sentence):
        if points > best:
            middle = k - (size - (at[last] + 1 - k)) // 2
            best, found = points, max(0, min(middle, n - size))
        if begin < k and n > size and more + (SENTENCE if begin else BEGIN) > best:
            best, found = more + (SENTENCE if begin else BEGIN), begin
    return found


def snippet(text: Column, terms: Column, size: int = 28) -> Column:
    """The stretch of `size` words with the most of the terms (lower-case), then with the most words of them, where a
    sentence's begin outweighs further words of the same terms; the first of equal ones. Words of terms stand between
    **, ` ... ` where text is left out. Without any, the text's begin. A null text or no terms gives null."""

    @F.pandas_udf("string")
    def shown(texts: pd.Series, asked: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or q is None else one(t, set(q)) for t, q in zip(texts, asked)], dtype=object)

    def one(text: str, asked: set[str]) -> str:
        words = [(m.start(), m.end()) for m in _WORDS.finditer(text)]
        if not words:
            return ""
        low = [text[a:b].lower() for a, b in words]
        at = [k for k, w in enumerate(low) if w in asked]
        start = 0
        if at:
            sentences = [0] + [k for k in range(1, len(words)) if _ENDED.search(text, words[k - 1][1], words[k][0])]
            start = _best_stretch(at, [low[k] for k in at], sentences, len(words), size)
        end, out = min(start + size, len(words)), []
        for k in range(start, end):
            a, b = words[k]
            out.append(f"**{text[a:b]}**" if low[k] in asked else text[a:b])
            if k + 1 < end:
                out.append(text[b : words[k + 1][0]])
        return (" ... " if start else "") + "".join(out) + (" ... " if end < len(words) else "")

    return shown(text, terms)


def hits_of(term: Column, text: Column) -> Column:
    """Whether a term is in a lower-cased text: words of four letters or more by all but their last, others whole."""
    part = F.left(term, F.greatest(F.lit(4), F.length(term) - 1))
    whole = F.array_contains(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), term)
    return F.when(F.length(term) >= 4, F.contains(text, part)).otherwise(whole)


def telling(terms: DataFrame, texts: DataFrame, most: float = 0.4) -> DataFrame:
    """Of terms (query_id, term) those that tell texts (id, text) apart: in at most that share of them."""
    n = texts.agg(F.count("*").alias("n"))
    words = terms.select("term").distinct()
    rows = words.withColumn("whole", F.length("term") < 4).withColumn("part", F.when(F.col("whole"), F.col("term")).otherwise(F.left("term", F.greatest(F.lit(4), F.length("term") - 1))))
    seen = rows.join(inside.counted(texts, rows.where(inside.plain(F.col("part"))).select("part", "whole").distinct()), ["part", "whole"]).select("term", "df")
    odd = rows.where(~inside.plain(F.col("part"))).select("term")  # strings of other characters are looked for one by one
    if not odd.isEmpty():
        low = texts.select("id", F.lower("text").alias("low")).join(F.broadcast(odd.agg(F.collect_set("term").alias("every"))))
        seen = seen.union(low.select(F.explode(F.filter("every", lambda t: hits_of(t, F.col("low")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    good = words.join(seen, "term", "left").crossJoin(F.broadcast(n)).where(F.coalesce("df", F.lit(0)) <= most * F.col("n")).select("term")
    return terms.join(good, "term", "left_semi")


#: Bits of the filter of names that is sent to all tasks.
FILTER_BITS = 1 << 25
_STEP, _PLACES = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, by where it begins."""
    n = max(0, len(hashes) - size + 1)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * _STEP + hashes[k : k + n]
    return out


def _places(runs: np.ndarray) -> list[np.ndarray]:
    """The two bits of the filter that each run has."""
    return [(runs * by) >> np.uint64(64 - FILTER_BITS.bit_length() + 1) for by in _PLACES]


def _numbers(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _hashes(words: str, size: str) -> tuple[Column, Column]:
    """Hashes of words as names of several are met, in any case; and as single ones are, as written."""
    low, plain = F.transform(words, lambda x: F.xxhash64(F.lower(x))), F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.col(size) > 1, low).alias("low"), F.when(F.col(size) > 0, plain).alias("plain")


def _name_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, bit) of the filter of names (size, low, plain)."""
    for batch in batches:
        sizes, found = batch.column("size").to_numpy(), []
        for size in np.unique(sizes):
            hashes = _numbers(batch.filter(pa.array(sizes == size)).column("low" if size > 1 else "plain"))
            found += _places(_runs(hashes, size)[::size])
        places = np.unique(np.concatenate([np.empty(0, np.uint64), *found])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array((places & 63).astype(np.int32))], ["word", "bit"])


def _name_filter(own: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, whatever the number of names (size, n)."""
    bits = own.select("size", *_hashes("n", "size")).mapInArrow(_name_bits, "word long, bit int")
    rows = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("b")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["b"].to_numpy().view(np.uint64)
    return out


def _said(bits, sizes: list[int]):
    """(id, at, size, said, sentence): runs of words of texts (id, w, low, plain) that may be names of one of those sizes,
    and what stands around them."""

    def around(words: pa.Array, begin: np.ndarray, end: np.ndarray) -> pa.Array:
        n = end - begin
        stops = np.cumsum(n)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), words.take(pa.array(np.repeat(begin - (stops - n), n) + np.arange(n.sum()))))
        return pc.utf8_slice_codeunits(pc.replace_substring(pc.binary_join(lists, " "), "\u0001", "…"), 0, 160)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("w")
            words, n = lists.flatten(), lists.value_lengths().to_numpy().astype(np.int64)
            text, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
            for size in sizes:
                runs = _runs(_numbers(batch.column("low" if size > 1 else "plain")), size)
                at = np.flatnonzero(np.arange(len(runs)) + size <= ends[text[: len(runs)]])  # a run lies in one text
                for places in _places(runs):
                    places = places[at]
                    at = at[(bits.value[places >> np.uint64(6)] >> (places & np.uint64(63)) & np.uint64(1)).astype(bool)]
                parts = [words.take(pa.array(at + k)) for k in range(size)]
                said = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
                of = text[at]
                first = (ends - n)[of]
                begin = np.maximum(first, at - 8)
                columns = [batch.column("id").take(pa.array(of)), pa.array((at - first).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), said, around(words, begin, np.minimum(begin + 20, ends[of]))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "at", "size", "said", "sentence"])

    return run


def _first_mentions(places: list[dict], shown: int) -> list[dict]:
    """Of a text's places (at, size, to_id, name, sentence) the first `shown` notes by their first mention. Of places that overlap
    the longest counts, then the first. Longer ones go before, so a place that overlaps one of them does with an end."""
    taken, first = set(), {}
    for x in sorted(places, key=lambda x: (-x["size"], x["at"], x["to_id"], x["name"])):
        if x["at"] in taken or x["at"] + x["size"] - 1 in taken:
            continue
        taken.update(range(x["at"], x["at"] + x["size"]))
        if x["to_id"] not in first or x["at"] < first[x["to_id"]]["at"]:
            first[x["to_id"]] = x
    return [{k: x[k] for k in ("to_id", "name", "at", "sentence")} for x in sorted(first.values(), key=lambda x: x["at"])[:shown]]


def mentions(notes: DataFrame, names: DataFrame, linked: DataFrame, most_share: float = 0.05, least_letters: int = 5, shown: int = 3) -> DataFrame:
    """(id, to_id, name, at, sentence): names of other notes in a note's text that it doesn't link to.

    notes (id, text), names (to_id, name), linked (id, to_id). Names of several words are found in any case, single words
    of least_letters letters or more as written and only where at most most_share of the texts have them. Code, links,
    addresses and headings don't count. Of names that overlap the longest counts; each note is told once, by its first
    mention, and the first `shown` of them. Texts meet names by whole names: runs of words that a bit filter of all
    names lets through are shuffled, so a frequent word that many names begin with costs no more than another.
    """
    small_batches(notes.sparkSession)
    mask = lambda c, p: F.regexp_replace(c, p, " \u0001 ")  # noqa: E731  a mark that is no word of a name
    text = F.col("text")
    for pattern in (r"(?s)(?m)^[ \t]*(```|~~~).*?(?:^[ \t]*\1|\z)", r"`[^`\n]*`", r"!?\[\[[^\]\n]*\]\]", r"\[[^\]\n]*\]\([^)\n]*\)", r"https?:\S+", r"(?m)^#{1,6}\s.*$"):
        text = mask(text, pattern)
    word = r"[\p{L}\p{N}]+|\x01"
    words = F.regexp_extract_all(text, F.lit(word), F.lit(0))
    own = names.select("to_id", "name", F.regexp_extract_all("name", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("n")).withColumn("size", F.size("n")).where("size > 0")
    own = cut(own.where((F.col("size") > 1) | (F.length(F.get("n", F.lit(0))) >= least_letters)))
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # a number for each length of a name
    bits = notes.sparkSession.sparkContext.broadcast(_name_filter(own))
    key = lambda parts: F.when(F.col("size") > 1, F.array_join(F.transform(parts, F.lower), " ")).otherwise(F.array_join(parts, " "))
    # only hashes that a name of some size needs
    body = notes.select("id", words.alias("w")).where(F.size("w") > 0).withColumn("most", F.lit(max(sizes, default=0)))
    low, plain = _hashes("w", "most")
    said = body.select("id", "w", low, plain if 1 in sizes else F.lit(None).cast("array<bigint>").alias("plain")).mapInArrow(_said(bits, sizes), f"id {dict(notes.dtypes)['id']}, at int, size int, said string, sentence string")
    said = said.select("id", "at", "size", key(F.split("said", " ")).alias("key"), "sentence")
    found = said.join(own.select("to_id", "name", "size", key(F.col("n")).alias("key")), ["key", "size"]).where("id <> to_id")
    # places are dealt by their text once, and stay there. Equality of to_id is written as two bounds, or Spark would deal by both
    parts = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places, known = found.select("id", "at", "size", "to_id", "name", "sentence").repartition(parts, "id").alias("p"), linked.select("id", "to_id").repartition(parts, "id").alias("k")
    same = (F.col("p.id") == F.col("k.id")) & (F.col("p.to_id") <= F.col("k.to_id")) & (F.col("p.to_id") >= F.col("k.to_id"))
    found = cut_as_dealt(places.join(known.hint("merge"), same, "left_anti"))
    single = found.where("size = 1").groupBy("name").agg(F.count_distinct("id").alias("df"))
    total = notes.agg(F.count("*").alias("total"))
    common = cut(single.crossJoin(F.broadcast(total)).where(F.col("df") > most_share * F.col("total")).select("name"))
    found = found.join(told(common), "name", "left_anti").groupBy("id").agg(F.collect_list(F.struct("at", "size", "to_id", "name", "sentence")).alias("places"))

    @F.pandas_udf(f"array<struct<to_id:{dict(names.dtypes)['to_id']},name:string,at:int,sentence:string>>")
    def first(texts: pd.Series) -> pd.Series:
        return pd.Series([_first_mentions(list(x), shown) for x in texts], dtype=object)

    return found.select("id", F.inline(first("places"))).select("id", "to_id", "name", "at", "sentence")
