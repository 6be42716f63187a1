"""Places of names are dealt by their text once."""

import contextlib
import io
import random

from lodestar.operators import expand


def test_places_are_dealt_once(spark):
    """What follows the places' one exchange by text has none; names that a note links to are left out, others not."""
    pick = random.Random(2)
    names = [(k, f"Thing{k:02d} of it") for k in range(30)]
    notes = [(k, " and ".join(names[pick.randrange(30)][1] for _ in range(6))) for k in range(100, 160)]
    linked = [(k, pick.randrange(30)) for k in range(100, 160) for _ in range(4)]
    got = expand.mentions(spark.createDataFrame(notes, "id long, text string"), spark.createDataFrame(names, "to_id long, name string"), spark.createDataFrame(linked, "id long, to_id long"), 1.0, shown=9)
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        got.explain()
    assert "hashpartitioning(id#" not in said.getvalue() and "hashpartitioning(name#" not in said.getvalue()
    want = {(i, k) for i, text in notes for k, name in names if name in text} - set(linked)
    assert {(r.id, r.to_id) for r in got.collect()} == want
    assert want and {(i, k) for i, text in notes for k, name in names if name in text} & set(linked)
