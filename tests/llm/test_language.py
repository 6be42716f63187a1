"""Language ID against a direct computation over explicit n-gram sets, and on many scripts."""

import math
import random
import re
import zlib

import numpy as np

from lodestar.llm import language

WORDS = {
    "en": "the and of that with for this from have not be they which were one all would there their said",
    "de": "der und die nicht mit das auch eine sich von dem des wird sind ist noch nach bei einer zum",
    "fr": "les des une dans que pour sur avec est par plus pas qui aux ses mais ont cette comme sont",
}


def made(words, n, seed, start=0):
    rng = random.Random(seed)
    return [
        (start + k, " ".join(rng.choice(words[lang]) + rng.choice(["", ",", " 12", "\n"]) for _ in range(rng.randint(3, 30))), lang)
        for k, lang in enumerate(rng.choice(sorted(words)) for _ in range(n))
    ]


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def spectrum(text):
    plain = re.sub(r"[^a-z]+", " ", text.lower())
    return {plain[k : k + n] for n in (1, 2, 3) for k in range(len(plain) - n + 1)}


def test_equals_the_direct_computation(spark):
    rows = made({k: v.split() for k, v in WORDS.items()}, 240, 1)
    rows += rows[:9]  # repeated rows are learned from once and predicted alike
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known, langs = language.sample(df)
    texts = {tuple(language.grams(x)): x for _, x, _ in rows}
    learned = [spectrum(texts[tuple(x)]) for x in known]
    assert len(known) <= len({r[0] for r in rows if not is_held_out(r[0])})
    universe = set().union(*learned)

    def k(x, y):
        return len(x & y & universe) / math.sqrt(max(1, len(x & universe)) * max(1, len(y & universe)))

    names = sorted(set(langs))
    marks = [i for name in names for i in [j for j, x in enumerate(langs) if x == name][: language.LANDMARKS]]
    marks.sort()
    inner = np.array([[k(learned[i], learned[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.array([[k(x, learned[j]) for j in marks] for x in learned]) @ root
    weight = np.array([1 / langs.count(x) for x in langs])
    gram = (features * weight[:, None]).T @ features + language.RIDGE * weight.sum() / len(names) * np.eye(features.shape[1])
    solved = {name: np.linalg.solve(gram, features.T @ (weight * np.array([float(x == name) for x in langs]))) for name in names}
    got = language.identified(df, ["doc_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        x = spectrum(r.text)
        scores = {name: float(np.array([k(x, learned[j]) for j in marks]) @ root @ c) for name, c in solved.items()}
        best = max(scores.values())
        assert abs(r.score - min(1, max(0, best))) < 2e-3
        assert scores[r.lang_pred] > best - 2e-3


def test_ties_go_to_the_first_language(spark):
    # two languages with the same texts
    rows = [(k, x, lang) for k, x in enumerate(["ab cd ef", "ab cd gh"] * 30) for lang in ("one", "two")]
    got = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()
    assert {r.lang_pred for r in got} <= {"one", "two"} and len({r.lang_pred for r in got if r.text == "ab cd ef"}) == 1


def test_many_scripts(spark):
    """Hundreds of letters in all, more than n-grams' table holds: each is told apart."""
    rng = random.Random(3)
    starts = {"ru": 0x430, "el": 0x3B1, "ar": 0x627, "hi": 0x915, "ko": 0xAC00, "zh": 0x4E00, "ka": 0x10D0, "he": 0x5D0}
    words = {k: ["".join(chr(v + rng.randrange(300 if k in ("ko", "zh") else 22)) for _ in range(rng.randint(2, 6))) for _ in range(60)] for k, v in starts.items()}
    words |= {k: v.split() for k, v in WORDS.items()}
    rows = made(words, 1500, 5)
    got = language.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), ["doc_id"]).collect()
    aims = {k: lang for k, _, lang in rows}
    held = [r for r in got if is_held_out(r.doc_id)]
    assert sum(r.lang_pred == aims[r.doc_id] for r in held) >= 0.95 * len(held)


def test_runs_of_non_letters_across_parts(monkeypatch):
    monkeypatch.setattr(language, "_BATCH_CHARS", 7)
    text = "ab" + " 1" * 9 + "cd efg" + "--" * 20 + "h i j" * 5
    g = language.Grams([language.grams(text)])
    assert np.array_equal(g.presence([text])[0] > 0, g.known_presence([language.grams(text)])[0] > 0)
    assert (g.presence([text])[0] > 0).all()


def test_every_letter_counts():
    """Presence by numbers of n-grams against sets of n-grams, with 400 letters: no letter stands for another."""
    rng = random.Random(12)
    letters = [chr(0x4E00 + k) for k in range(200)] + [chr(0xAC00 + k) for k in range(150)] + [chr(0x430 + k) for k in range(30)] + list("abcdefghijklmnopqrst")
    texts = ["".join(rng.choice(letters + [" ", "1", ".."]) for _ in range(rng.choice([0, 1, 2, 50, 400]))) for _ in range(60)]

    def ngrams(x):
        plain = re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0][0].isalpha() else " ", x.lower(), flags=re.S)
        plain = re.sub(" +", " ", plain)
        return {plain[k : k + n] for n in (1, 2, 3) for k in range(len(plain) - n + 1)}

    learned = [x for x in texts[:40] if x]
    g = language.Grams([language.grams(x) for x in learned])
    assert g.columns is None
    universe = set().union(*map(ngrams, learned))
    assert g.size == len(universe)
    got, known = g.presence(texts), g.presence(learned)
    want = np.array([[len(ngrams(a) & ngrams(b) & universe) for b in learned] for a in texts])
    assert np.array_equal((got @ known.T).astype(int), want)
    few = [x for x in ("ab cd", "bc da", "cab") for _ in range(2)]
    small, large = (language.Grams([language.grams(x) for x in few], d) for d in (1 << 20, 0))
    assert small.columns is not None and large.columns is None
    assert np.array_equal(small.presence(few + ["zz a", ""]), large.presence(few + ["zz a", ""]))
