"""New facts beside many current ones."""

import random

from lodestar.sources import memory


def test_pairs_against_brute_force(spark, monkeypatch):
    """Chunks and blocks of a few facts and terms give what all pairs give, and a few rows a chunk leave a task."""
    for name, n in (("CHUNK", 7), ("BLOCK", 3), ("TERMS", 20), ("SLICE", 5)):
        monkeypatch.setattr(memory, name, n)
    rng = random.Random(5)
    fact = lambda k: (f"f{k:02d}", rng.choice(["a", "b", None]), None, rng.choice([None, []]) if k % 9 == 0 else rng.sample("abcdefgh", rng.randint(1, 6)))
    old, new = [fact(k) for k in range(60)], [(*fact(k), [f"f{k % 50:02d}"] if k % 4 == 0 else [], False) for k in range(60, 90)]
    kind = lambda j, c: "duplicate" if j >= 0.6 or c >= 0.85 else "update" if j >= 0.3 else "new"
    want = {}
    for i, category, _, terms, named, _ in new:
        met = []
        for o, other, _, more in old:
            both = len(set(terms or ()) & set(more or ()))
            if both and o not in named:
                j, c = both / (len(terms) + len(more) - both), both / min(len(terms), len(more))
                met.append((-max(j, 0.9 * c), o, kind(j, c), category is not None and category == other))
        best, near = min(met, default=None), min((x for x in met if x[3]), default=None)
        want[i] = ("duplicate", best[1]) if best and best[2] == "duplicate" else ("held", near[1]) if not named and near and near[2] == "update" else ("stored", None)
    schema = "id string, category string, key string, terms array<string>"
    got = memory.remembered(spark.createDataFrame(new, schema + ", named array<string>, force boolean"), spark.createDataFrame(old, schema)).collect()
    assert {r.id: (r.verdict, r.match) for r in got} == want
