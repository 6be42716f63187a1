"""SentencePiece encoding and decoding by a streaming trellis.

The trellis has a node for each character boundary and an arc for each vocabulary piece. Only the last
max-piece-length boundaries can start an arc that is still to come, so only those are kept as a window; whenever the
backpointer paths of all of them meet in one boundary, the ids before it are final and are committed. The trellis is
fed word by word where no piece spans the boundary before a word, as all paths meet there; ids of words are remembered.

Two kinds of model:
- unigram: arcs add their scores and a boundary keeps its best path (Viterbi);
- bpe: a boundary keeps the one path that is the model's own segmentation of the text before it. A path may be
  extended by a piece if merging its last piece and that piece gives back these two, which decides between all
  paths that reach a boundary; scores don't add up in a BPE model, so the best sum would give other ids.
Characters that no piece has become their UTF-8 bytes.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

MODEL = "piece_bpe_32k.model"
#: Words whose ids a process remembers, twice over, and pairs of pieces whose fit it remembers.
REMEMBERED = 500_000
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that keep texts as they are")
        self.bpe = m.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.prefix = spec.add_dummy_prefix
        kinds = pb.ModelProto.SentencePiece
        self.ids = {p.piece: k for k, p in enumerate(m.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.scores = [p.score for p in m.pieces]
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(m.pieces) if p.type == kinds.BYTE}
        self.unknown = next(k for k, p in enumerate(m.pieces) if p.type == kinds.UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.text = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.replace(SPACE, " ").encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else b"" for p in m.pieces]
        # the library sums in 32 bits, and where paths have equal scores the rounding decides
        self.single = [np.float32(x) for x in self.scores]
        self.low = np.float32(min((p.score for p in m.pieces if p.type == kinds.NORMAL), default=0.0)) - np.float32(10)  # an unknown character's score in a unigram model
        # pieces hold the space mark in front only, so no piece spans the boundary before a mark that follows another character
        self.words_apart = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        self.begins = {p[:k] for p in self.ids for k in range(1, len(p))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.ways: dict[str, tuple | None] = {}  # at most one for each piece and unknown character

    def steps(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """How the model merges a piece by itself, the best-scored neighbours first, the leftmost on ties: the score of
        each merge, and the outermost parts before the first and after each. None if it doesn't become one part."""
        known = self.ways.get(piece, ())
        if known != ():
            return known
        parts, scores, lefts, rights = list(piece), [], [piece[0]], [piece[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                one = self.ids.get(parts[k] + parts[k + 1])
                if one is not None and (best is None or self.scores[one] > best):
                    best, at = self.scores[one], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            lefts.append(parts[0])
            rights.append(parts[-1])
        self.ways[piece] = way = (scores, lefts, rights) if len(parts) == 1 else None
        return way

    def fit(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b: no merge across them comes before those inside. An empty a stands for
        the text's begin."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            known = self.fits[key] = self._fit(a, b)
        return known

    def _fit(self, a: str, b: str) -> bool:
        right = self.steps(b)
        if right is None or not a:
            return right is not None
        left = self.steps(a)
        if left is None:
            return False
        i = j = 0
        while True:
            across = self.ids.get(left[2][i] + right[1][j])
            score = None if across is None else self.scores[across]
            x = left[0][i] if i < len(left[0]) else None
            y = right[0][j] if j < len(right[0]) else None
            # of equal scores the leftmost goes first: inside a, across, inside b
            if score is not None and (x is None or score > x) and (y is None or score >= y):
                return False
            if x is not None and (y is None or x >= y):
                i += 1
            elif y is not None:
                j += 1
            else:
                return True


class Stream:
    """Encodes a text given in parts; feed() returns the pieces that have become final.

    back has of each boundary of the window the arc that its best path ends with: (begin, piece, score), None where no
    path has come yet. Arcs are laid forward, from boundary to boundary, as soon as all text they may cover is here;
    boundaries from `next` on haven't laid theirs.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.chars = ""  # from the window's first boundary on
        self.back: list = [(0, "", np.float32(0))]
        self.next = 0

    def feed(self, text: str, end: bool = False) -> list[str]:
        """Final pieces after so much more (already escaped) text; end: no more comes."""
        self.chars += text
        n = len(self.chars)
        self.back += [None] * (n + 1 - len(self.back))
        stop = n if end else n - self.v.longest + 1
        if stop > self.next:
            (self._merges if self.v.bpe else self._sums)(stop)
            self.next = stop
        cut = n if end else self._meeting()
        out = self._path(cut)
        if out:
            self.chars, self.next = self.chars[cut:], self.next - cut
            self.back = [(0, *self.back[cut][1:]), *(b and (b[0] - cut, b[1], b[2]) for b in self.back[cut + 1 :])]
        return out

    def _merges(self, stop: int) -> None:
        v, chars, back = self.v, self.chars, self.back
        ids, fits, begins, n = v.ids, v.fits, v.begins, len(chars)
        for j in range(self.next, stop):
            if back[j] is None:
                continue
            before, i = back[j][1], j + 1
            while True:
                piece = chars[j:i]
                if back[i] is None and (piece in ids or i == j + 1):
                    fit = fits.get((before, piece))
                    if v.fit(before, piece) if fit is None else fit:
                        back[i] = (j, piece, 0.0)
                if i == n or piece not in begins:
                    break
                i += 1

    def _sums(self, stop: int) -> None:
        v, chars, back = self.v, self.chars, self.back
        ids, begins, n = v.ids, v.begins, len(chars)
        for j in range(self.next, stop):
            score, i = back[j][2], j + 1  # single characters reach every boundary
            while True:
                piece = chars[j:i]
                k = ids.get(piece)
                if k is not None or i == j + 1:
                    one = score + (v.single[k] if k is not None else v.low)
                    if back[i] is None or one > back[i][2]:
                        back[i] = (j, piece, one)
                if i == n or piece not in begins:
                    break
                i += 1

    def _meeting(self) -> int:
        """The last boundary without arcs to lay that the paths of all boundaries which have still to lay theirs go through."""
        alive = {k for k in range(self.next, len(self.back)) if self.back[k] is not None}
        while len(alive) > 1 or max(alive) > self.next:
            top = max(alive)
            alive.remove(top)
            alive.add(self.back[top][0])
        return alive.pop()

    def _path(self, end: int) -> list[str]:
        out = []
        while end > 0:
            begin, piece, _ = self.back[end]
            out.append(piece)
            end = begin
        return out[::-1]


class Codec:
    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _ids(self, pieces: list[str]) -> list[int]:
        v, out = self.v, []
        for p in pieces:
            k = v.ids.get(p)
            if k is not None:
                out.append(k)
            elif v.bytes:
                out += [v.bytes[b] for b in p.encode()]
            elif not out or out[-1] != v.unknown:  # a run of unknown characters is one
                out.append(v.unknown)
        return out

    def _joined(self, out: list[int], more: list[int]) -> list[int]:
        """out with more ids; a run of unknown characters across is one."""
        out += more[1:] if not self.v.bytes and out and more and out[-1] == more[0] == self.v.unknown else more
        return out

    def _stream(self, escaped: str, step: int = 4096) -> list[int]:
        stream, out = Stream(self.v), []
        while len(escaped) > step:
            self._joined(out, self._ids(stream.feed(escaped[:step])))
            escaped = escaped[step:]
        return self._joined(out, self._ids(stream.feed(escaped, end=True)))

    def encode(self, text: str) -> list[int]:
        """The ids of a text. An empty one has none."""
        if not text:
            return []
        escaped = (SPACE if self.v.prefix else "") + text.replace(" ", SPACE)
        if not (self.v.bpe and self.v.words_apart):  # sums run on over words
            return self._stream(escaped)
        # all paths meet before a mark that follows another character, so words are final by themselves and are remembered
        out: list[int] = []
        known, get = self.known, self.known.get
        for word in self.split(escaped):
            ids = get(word)
            if ids is None:
                ids = self.older.get(word)
                if ids is None:
                    ids = self._stream(word)
                if len(word) <= 64:  # longer ones hardly come again
                    if len(known) >= REMEMBERED:  # words that stay in use move to the new generation
                        self.older = known
                        known = self.known = {}
                        get = known.get
                    known[word] = ids
            if self.v.bytes:
                out += ids
            else:
                self._joined(out, ids)
        return out

    def decode(self, ids) -> str:
        """The text of ids; inverts encode()."""
        text = self.v.text
        data = b"".join([text[k] for k in ids])
        out = data.decode("utf-8", "replace")
        return out[1:] if self.v.prefix and out.startswith(" ") else out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo in range(0, batch.num_rows, 128):  # ids of few texts at once
                part = batch.slice(lo, 128)
                ids = [None if x is None else c.encode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, "ids"])

    return run


def _checked(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        byte = np.zeros(len(c.v.text), dtype=bool)
        byte[list(c.v.bytes.values())] = True
        for batch in batches:
            n, n_bytes, digests, same = [], [], [], []
            for x in batch.column("text").to_pylist():
                ids = c.encode(x or "")
                row = np.array(ids, dtype="<i4")
                n.append(len(ids))
                n_bytes.append(int(byte[row].sum()))
                digests.append(hashlib.sha256(row.tobytes()).hexdigest())
                same.append(c.decode(ids) == (x or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(digests), pa.array(same)],
                ["doc_id", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"],
            )

    return run


def encoded(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """docs (text string, ...) -> the columns keep, text and ids array<int> of each row.

    ids are the library's for the whole text, without begin and end. A null text has null ids, an empty one none.
    Repeated rows are encoded alike. Columns beside keep are ignored, so none can clash. No rows: no rows.
    """
    rows = docs.select(*keep, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_encode(path or model_path()), types + ", ids array<int>")


def decoded(rows: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """rows (ids array<int>, ...) -> the columns keep and text string; null ids give a null text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column("ids").to_pylist()]
            kept = [batch.column(k) for k in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*keep, "text"])

    kept = rows.select(*keep)
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    return rows.select(*keep, "ids").mapInArrow(run, types + "text string")


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, n_byte_pieces, ids_sha256 of the ids as little-endian 32-bit numbers, round_trip) of each
    document; round_trip says whether decoding gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_checked(model_path()), "doc_id long, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean")
