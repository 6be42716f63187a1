"""Language identification with a string kernel.

Kernel: blended-spectrum presence, k(x, y) = |P(x) & P(y)| / sqrt(|P(x)| |P(y)|), where P(x) is the set of character
n-grams (n = 1..3, of the lower-cased text with runs of non-letters as one space) of x. Landmarks from the labelled
sample span a Nyström approximation: with K the kernel among landmarks, the features of x are k(x, landmarks) K^(-1/2),
and one-versus-rest kernel ridge regression on them is linear. Scoring is two matrix products a batch: the batch's
0/1 n-gram matrix with the landmarks' one gives all kernel values, those with the coefficients all scores.

The n-gram universe is that of the sample, so P counts known n-grams only. Sampled texts are read whole in the tasks,
which send on their distinct n-grams: all that a presence kernel sees of a text, however long it is.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: The sample to learn from has at most SAMPLE rows of each language, and at most ROWS in all.
SAMPLE, ROWS = 256, 4096
#: Of which so many of each language are landmarks.
LANDMARKS = 48
#: Up to so many possible n-grams their columns stand in a table; beyond, the known ones are searched. The result is the same.
DENSE = 1 << 23
RIDGE = 1e-3
_N = 3
#: Characters in a batch of presence rows.
_BATCH_CHARS, _BATCH_ROWS = 1 << 20, 256
#: Bytes of the presence rows that are scored at once.
_PRESENCE_BYTES = 1 << 26


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def grams(text: str) -> list[str]:
    """The distinct 3-grams of a text, runs of non-letters as one space; they hold the 1- and 2-grams. A text of fewer
    than three has itself."""
    import regex

    plain = regex.sub(r"\P{L}+", " ", text.lower())
    return sorted({plain[k : k + _N] for k in range(max(1, len(plain) - _N + 1))})


class Grams:
    """Which known n-grams a text has. known: the grams() of each text to learn from."""

    def __init__(self, known: list[list[str]], dense: int = DENSE):
        every = sorted(set("".join("".join(x) for x in known)) - {" "})
        #: Letters of the texts to learn from are 2.., any other letter is 1, all else 0
        self.base = len(every) + 2
        self.table = np.zeros(max(map(ord, ["z", *every])) + 1, dtype=np.int32)
        self.table[ord("a") : ord("z") + 1] = 1
        self.table[list(map(ord, every))] = np.arange(2, len(every) + 2)
        found = [np.unique(self.known_codes(x)) for x in known]
        self.universe = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        self.size, possible = len(self.universe), sum(self.base**n for n in range(1, _N + 1))
        self.columns = None
        if possible <= dense:
            self.columns = np.full(possible, -1, dtype=np.int32)
            self.columns[self.universe] = np.arange(self.size, dtype=np.int32)

    def column(self, codes: np.ndarray) -> np.ndarray:
        """The columns of n-grams; -1 for unknown ones."""
        if self.columns is not None:
            return self.columns[codes]
        at = np.minimum(np.searchsorted(self.universe, codes), max(self.size - 1, 0))
        return np.where(self.universe[at] == codes, at, -1) if self.size else np.full(len(codes), -1)

    def known_codes(self, x: list[str]) -> np.ndarray:
        """The numbers of all n-grams in a text's grams()."""
        long = self.mapped("".join(g for g in x if len(g) == _N)).reshape(-1, _N)
        parts, code, start = [], [long[:, k].astype(np.int64) for k in range(_N)], 0
        for n in range(1, _N + 1):
            parts += [c + start for c in code]
            code = [code[k] * self.base + long[:, k + n] for k in range(_N - n)]
            start += self.base**n
        return np.concatenate([*parts, *(self.codes(self.mapped(g)) for g in x if len(g) < _N)])

    def mapped(self, text: str) -> np.ndarray:
        """The letter codes of a text."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        far = points >= len(self.table)
        codes = self.table[np.where(far, 0, points)]
        codes[far] = 0
        unknown = np.flatnonzero((codes == 0) & (points > 127))
        if len(unknown):
            kinds, back = np.unique(points[unknown], return_inverse=True)
            codes[unknown] = np.array([1 if chr(c).isalpha() else 0 for c in kinds.tolist()], dtype=np.int32)[back]
        return codes

    def letters(self, text: str) -> Iterator[np.ndarray]:
        """Codes of a whole text's letters with each run of others as one 0, in parts that overlap by n - 1."""
        tail = np.empty(0, np.int32)
        for lo in range(0, len(text), _BATCH_CHARS):
            codes = np.concatenate([tail, self.mapped(text[lo : lo + _BATCH_CHARS].lower())])
            if len(codes):
                codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
            yield codes
            tail = codes[len(codes) - _N + 1 :] if len(codes) >= _N else codes

    def codes(self, letters: np.ndarray) -> np.ndarray:
        """A number for each n-gram at each place; n-grams of other n have other numbers."""
        out, start, code = [], 0, letters.astype(np.int64)
        for n in range(1, _N + 1):
            if n > 1:
                code = code[: max(0, len(letters) - n + 1)] * self.base + letters[n - 1 :]
            out.append(code + start)
            start += self.base**n
        return np.concatenate(out)

    def presence(self, texts: list[str]) -> np.ndarray:
        """0/1 rows, one for each text."""
        rows = np.zeros((len(texts), self.size + 1), dtype=np.float32)
        for k, x in enumerate(texts):
            for part in self.letters(x):
                rows[k, self.column(self.codes(part))] = 1
        return rows[:, : self.size]  # unknown n-grams went to the last column

    def known_presence(self, known: list[list[str]]) -> np.ndarray:
        """presence() of the texts to learn from, by their grams()."""
        rows = np.zeros((len(known), self.size), dtype=np.float32)
        for k, x in enumerate(known):
            rows[k, self.column(self.known_codes(x))] = 1
        return rows


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(y.sum(1), 1))[None, :]
    return (x @ y.T) / norm


class Model:
    """Fitted on texts' grams() and languages; an empty sample gives a model without languages."""

    def __init__(self, known: list[list[str]], langs: list[str]):
        self.langs = sorted(set(langs))
        self.grams = Grams(known)
        if not known:
            return
        x = self.grams.known_presence(known)
        chosen, taken = [], dict.fromkeys(self.langs, 0)
        for k, lang in enumerate(langs):
            if taken[lang] < LANDMARKS:
                taken[lang] += 1
                chosen.append(k)
        self.landmarks = x[chosen]
        values, vectors = np.linalg.eigh(kernel(self.landmarks, self.landmarks).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        features = kernel(x, self.landmarks).astype(np.float64) @ root
        aims = np.array([[float(a == b) for b in self.langs] for a in langs])
        # rows of rare languages weigh as much as those of common ones
        weight = np.array([1 / langs.count(a) for a in langs])[:, None]
        left = features.T @ (weight * features) + RIDGE * np.eye(features.shape[1]) * weight.sum() / len(self.langs)
        self.coefficients = (root @ np.linalg.solve(left, features.T @ (weight * aims))).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        rows = max(1, _PRESENCE_BYTES // (4 * (self.grams.size + 1)))
        parts = [kernel(self.grams.presence(texts[k : k + rows]), self.landmarks) @ self.coefficients for k in range(0, len(texts), rows)]
        scores = np.concatenate(parts) if parts else np.empty((0, len(self.langs)))
        best = scores.argmax(1)
        return [self.langs[k] for k in best], np.clip(scores[np.arange(len(texts)), best], 0, 1).astype(float).tolist()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = pa.array([grams(x) for x in batch.column("text").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), known], ["lang", "h", "known"])


def sample(docs: DataFrame) -> tuple[list[list[str]], list[str]]:
    """The grams() and languages of at most SAMPLE labelled rows of each language that aren't held out, and of at most
    ROWS in all. ROWS is shared evenly: every language has its first row before any has its second.

    Rows are dealt by a hash of their id to SAMPLE places of their language and each place keeps the row with the
    smallest hash: a uniform choice that no task has to hold more for than a place a language.
    """
    usable = docs.where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).select("lang", "text", F.xxhash64(F.col("doc_id"), F.lit("sample")).alias("h"))
    first = usable.groupBy("lang", F.pmod(F.col("h"), F.lit(SAMPLE)).alias("place")).agg(F.min("h").alias("h"))
    first = first.withColumn("no", F.row_number().over(W.partitionBy("lang").orderBy("h")))  # SAMPLE rows a language
    first = first.orderBy("no", "h", "lang").limit(ROWS).select("lang", "h")
    # first has ROWS rows at most
    rows = usable.join(F.broadcast(first), ["lang", "h"]).dropDuplicates(["lang", "h"])
    rows = rows.select("lang", "h", "text").mapInArrow(_digest, "lang string, h long, known array<string>").orderBy("h", "lang").collect()
    return [r.known for r in rows], [r.lang for r in rows]


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)

            def flush(rows: list[int]) -> None:
                for k, lang, score in zip(rows, *m.predict([texts[k] for k in rows])):
                    langs[k], scores[k] = lang, score

            rows, size = [], 0
            for k, x in enumerate(texts):
                if x and any(map(str.isalpha, x)):
                    rows.append(k)
                    size += len(x)
                if size >= _BATCH_CHARS or len(rows) >= _BATCH_ROWS:
                    flush(rows)
                    rows, size = [], 0
            if rows:
                flush(rows)
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score"])

    return run


def identified(docs: DataFrame, keep: list[str], model: Model | None = None) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> the columns keep, text, lang_pred string and score double of each row.

    The model is fitted on a sample() of docs unless given. lang_pred is a learned language, or und (score 0) where
    the text is null or has no letter, or nothing could be learned. Whole texts are read, of any length. Languages
    with equal scores: the alphabetically first. Repeated rows are predicted alike; null lang is not learned
    from. Columns beside keep are ignored, so none can clash. No rows: no rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(model or Model(*sample(docs)))
    rows = docs.select(*keep, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_predict(told), types + ", lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    got = identified(table(spark, sf_dir, "documents"), ["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
