"""The first paragraph of odd texts."""

import itertools
import random

from pyspark.sql import functions as F

from conftest import compare
from lodestar.functions.text import first_paragraph
from lodestar.plans import q_text
from lodestar.registry import ORACLES


def test_texts_with_odd_spaces_equal_sql(spark, tmp_path):
    """Empty texts, spaces that aren't ASCII's, vertical tabs and the like, in all short orders and in random longer ones."""
    signs = ["", " ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", "\u200b", "\ufeff", "a", "# ", "---", "#"]
    pick = random.Random(3)
    texts = ["".join(x) for x in itertools.product(signs, repeat=3)] + ["".join(pick.choices(["a", "b c", "\n", *signs], k=12)) for _ in range(2000)]
    spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "made"))
    for t in ("region nation customer supplier part orders lineitem events embeddings pages benchmark labels conversations").split():
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    (tmp_path / "documents.parquet").symlink_to(next((tmp_path / "made").glob("part-*.parquet")))
    compare(spark, "first_paragraph", q_text.first_paragraph, ORACLES["first_paragraph"], str(tmp_path))


def test_paragraph(spark):
    text = "# T\n\n---\n \xa0 one \n\xa0\n\xa0# two\n\nthree"
    assert spark.range(1).select(first_paragraph(F.lit(text)).alias("p")).first().p == "one # two"
