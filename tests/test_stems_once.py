"""Words of the texts are gone through once for their stems."""

from pyspark.sql import functions as F

from lodestar.operators import expand
from lodestar.operators import retrieval as R


def test_the_vocabulary_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            read.add(len(x))
            yield x

    rows = spark.createDataFrame([(1, ["pumps", "motoring"]), (2, ["pump", "café"]), (3, ["nothing"])], "key long, text array<string>")
    vocabulary = rows.select(F.explode("text").alias("term")).distinct().mapInPandas(counted, "term string")
    q = spark.createDataFrame([("a", ["pumping", "motor"]), ("b", ["cafe", "zebra"])], "query_id string, terms array<string>")
    forms, asked = expand.stem_forms(vocabulary, q)
    got = {(r.query_id, r.key): r.matched for r in R.bm25(rows, asked, {"text": 1.0}, forms).collect()}
    assert got == {("a", 1): 2, ("a", 2): 1, ("b", 2): 1}
    assert {(r.term, r.form) for r in forms.collect()} >= {("pumps", "pump"), ("pump", "pump"), ("motoring", "motor"), ("café", "cafe")}
    assert read.value == 5
