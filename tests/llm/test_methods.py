"""Operators against brute force where the given tables don't reach: quotes, unigram models, proximity, hosts, large groups."""

import random
import re
from collections import Counter, defaultdict

import pytest

from lodestar.llm import chat, decontaminate, jaccard, pieces, quality


# --- quotes
def cells(text):
    """(at, level, part, body) of the passages and lines of a text."""
    out, run = [], []

    def close():
        if run:
            at, level = run[-1][0], run[0][1]
            out.append((at, level, 0, " ".join(x[2] for x in run)))
            if len(run) > 1:
                out.extend((k, level, 1, body) for k, _, body in run)
            run.clear()

    for k, line in enumerate(re.split("\r?\n", text or "")):
        marks = re.match(r"(?:[ \t]*>)*", line)[0]
        body = re.sub(r"\s+", " ", line[len(marks) :]).strip(" ").lower()
        if run and (marks.count(">") != run[0][1] or not body):
            close()
        if body:
            run.append((k, marks.count(">"), body))
    close()
    return out


def linked(rows):
    """{(conv, turn): (n_quotes, parent, by)} for rows (conv, turn, text)."""
    wrote = defaultdict(set)
    for conv, turn, text in rows:
        for _, level, _, body in cells(text):
            if level == 0:
                wrote[body].add((conv, turn))
    turns = defaultdict(list)
    for conv, turn, _ in rows:
        turns[conv].append(turn)
    out = {}
    for conv, turn, text in rows:
        best, n = None, 0
        for at, level, part, body in cells(text):
            if not level:
                continue
            n += part == 0
            own = [t for c, t in wrote[body] if c == conv and t < turn]
            other = [(c, t) for c, t in wrote[body] if c != conv] if len(body) >= chat.LEAST_CHARS else []
            to = (conv, max(own)) if own else min(other) if other else None
            if to and (best is None or (level, -at, part, to) < best):
                best = (level, -at, part, to)
        before = [t for t in turns[conv] if t < turn]
        if best:
            out[conv, turn] = (n, best[3], "quote")
        else:
            out[conv, turn] = (n, (conv, max(before)), "order") if before else (n, None, "start")
    return out


def talk(seed):
    """Conversations whose messages quote their own and conversation 0, nested, in part, short and long."""
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("alpha beta gamma delta eps zeta Eta THETA".split()) for _ in range(rng.choice([1, 2, 4, 7])))
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(2, 9)):
            parts = []
            for _ in range(rng.randint(1, 3)):
                mine = [x for c, _, x in rows if c in (0, conv)]
                if mine and rng.random() < 0.6:
                    source = rng.choice(mine).split("\n")
                    lo = rng.randrange(len(source))
                    parts.append("\n".join(rng.choice(["> ", ">", " > "]) + x for x in source[lo : lo + rng.randint(1, 4)]))
                parts.append("\n".join(line() for _ in range(rng.randint(1, 3))))
            rows.append((conv, turn, rng.choice(["\n\n", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quotes_against_brute_force(spark, seed):
    rows = talk(seed)
    want = linked(rows)
    got = {(r.conv_id, r.turn): r for r in chat.conversations(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows) and sum(v[2] == "quote" for v in want.values()) > 10
    assert {v[2] for v in want.values()} >= {"quote", "order", "start"}
    texts = {(c, t): x for c, t, x in rows}
    for k, (n, parent, by) in want.items():
        r = got[k]
        assert (r.n_quotes, r.linked_by, (r.parent_conv, r.parent_turn) if parent else None) == (n, by, parent), (k, texts[k])
        depth, at = 0, k
        while want[at][1]:
            at, depth = want[at][1], depth + 1
        assert ((r.root_conv, r.root_turn), r.depth) == (at, depth)
        own = "\n".join(x for x in texts[k].split("\n") if not re.match(r"[ \t]*>", x))
        assert r.content == re.sub(r"^\s*\n|\n\s*$", "", own)


def test_a_long_message(spark):
    """Thousands of passages in one message."""
    text = "\n\n".join(f"> old passage number {k} of many" if k % 2 else f"new passage number {k} of many" for k in range(3000))
    old = "\n\n".join(f"old passage number {k} of many" for k in range(3000))
    rows = [(1, 0, "user", old), (1, 1, "user", "between"), (1, 2, "assistant", text)]
    got = {r.turn: r for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[2].n_quotes, got[2].parent_turn, got[2].linked_by) == (1500, 0, "quote") and got[2].content.count("new passage") == 1500


# --- unigram models
def small_model(path, bytes_too):
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng, m = random.Random(5), pb.ModelProto()
    kinds = pb.ModelProto.SentencePiece
    add = lambda piece, score, kind=kinds.NORMAL: m.pieces.add(piece=piece, score=score, type=kind)
    add("<unk>", 0, kinds.UNKNOWN), add("<s>", 0, kinds.CONTROL), add("</s>", 0, kinds.CONTROL)
    if bytes_too:
        for b in range(256):
            add(f"<0x{b:02X}>", 0, kinds.BYTE)
    seen = set()
    for x in ["▁", *"abcde", "ä", *("".join(rng.choice("abcdeä▁") for _ in range(rng.randint(2, 6))) for _ in range(150))]:
        if x not in seen and "▁" not in x[1:]:
            seen.add(x)
            add(x, -rng.uniform(1, 12))
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    m.trainer_spec.byte_fallback = bytes_too
    m.normalizer_spec.add_dummy_prefix = True
    m.normalizer_spec.remove_extra_whitespaces = False
    m.normalizer_spec.escape_whitespaces = True
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("bytes_too", [True, False])
def test_unigram_model_equals_the_library(tmp_path, bytes_too):
    import sentencepiece

    path = small_model(tmp_path / "small.model", bytes_too)
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(path)
    rng = random.Random(6)
    texts = ["", "a", "  a  b ", "zzz zz", "xay", "äää", "東京 abc"] + ["".join(rng.choice("abcdeä  z") for _ in range(rng.randint(1, 300))) for _ in range(150)]
    for x in texts:
        want = library.encode(x)
        assert codec.encode(x) == want, x
        escaped = "▁" + x.replace(" ", "▁")
        for step in (1, 7, 64):
            assert not x or codec._stream(escaped, step) == want, (x, step)
        if bytes_too:
            assert codec.decode(want) == x


def test_the_window_is_bounded():
    v = pieces.codec(pieces.model_path()).v
    stream, most = pieces.Stream(v), 0
    for k in range(300):
        stream.feed("a" * 50 + ("▁b" if k % 3 else "ß"))
        most = max(most, len(stream.chars))
    assert most < 4 * v.longest + 200


# --- proximity
def spans(words, item):
    terms, best = set(item), None
    for lo in range(len(words)):
        need = set(terms)
        for hi in range(lo, len(words)):
            need.discard(words[hi])
            if not need:
                best = min(best or 10**9, hi - lo + 1)
                break
    return best


def test_proximity_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice([f"w{k}" for k in range(14)])
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(60, None), (61, ""), (None, "w1 w2 w3")]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 6)))) for k in range(25)] + [(30, None), (31, "..."), (32, "absent w1"), (None, "w1")]
    got = {(r.doc_id, r.item_id): r.span for r in decontaminate.proximity_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 3).collect()}
    want = {}
    for d, x in docs:
        for i, y in items:
            w, t = re.findall("[0-9a-z]+", x or ""), re.findall("[0-9a-z]+", y or "")
            if d is not None and i is not None and t and (n := spans(w, t)) and n <= len(t) + 3:
                want[d, str(i)] = n
    assert got == want and len(want) > 50


# --- hosts
def test_hosts_against_brute_force(spark):
    rng = random.Random(9)
    good, bad = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(60)), lambda: "too short"
    rates = {"a.org": 0.0, "b.org": 0.1, "bad.org": 0.9, "worse.org": 1.0, "one.org": 1.0, "mid.org": 0.5}
    rows = [(k, bad() if rng.random() < rates[h] else good(), h) for k, h in enumerate(h for h, n in zip(rates, (40, 40, 40, 30, 1, 20)) for _ in range(n))]
    rows += rows[:5] + [(900, good(), None), (901, bad(), None), (902, None, "a.org")]
    got = Counter((r.doc_id, r.host, r.base_failed, r.kept) for r in quality.judged(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_words int")).collect())
    fails = lambda x: len((x or "").split()) < 50
    n, f = Counter(h for _, _, h in rows if h), Counter(h for _, x, h in rows if h and fails(x))
    raw = [f[h] / n[h] for h in n]
    m = sum(raw) / len(raw)
    v = sum((x - m) ** 2 for x in raw) / len(raw)
    ab = m * (1 - m) / v - 1 if v > 0 and m * (1 - m) > v else quality.WEIGHT
    over = {h for h in n if (f[h] + m * ab) / (n[h] + ab) > quality.MAX_RATE}
    assert got == Counter((k, h, fails(x), not fails(x) and h not in over) for k, x, h in rows)
    assert {"bad.org", "worse.org"} <= over and "a.org" not in over
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.judged(empty).collect() == []


# --- large groups
def test_a_large_group_of_edited_copies(spark):
    """Copies of one text, many of them too far from it to link, and from each other unless they share edits."""
    rng = random.Random(10)
    base = [f"b{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 500):
        w = list(base)
        for _ in range(rng.choice([1, 3, 5, 7])):
            w[rng.randrange(len(w))] = f"e{k}x{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    for k in range(500, 540):  # edits in common
        w = [f"c{j}" if j % 12 == 0 else x for j, x in enumerate(base)]
        w[rng.randrange(len(w))] = f"y{k}"
        rows.append((k, " ".join(w)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split() for _, x in rows)]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (len(sets[k]), top(k)) for k in range(len(rows))}
    assert len({x for _, x in got.values()}) > 50
