"""Running sums over any number of rows, where a window over a key, or over everything, would be one task's work."""

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..lineage import cut


def running_sum(rows: DataFrame, value: Column, order: list[Column], by: list[str] | None = None, name: str = "used") -> DataFrame:
    """rows with the sum of value up to and with each row, in the order given, within each key of `by` (or over all).

    Rows are dealt by ranges of key and order. Each range has its own running sum, and the sums of whole ranges before
    it, of which there is one a range and key, are added. order has to tell all rows apart; a null value counts as
    nothing, null keys are a key. Give sizes and ids, and join texts to what is left.
    """
    by = by or []
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("_v", F.coalesce(value, F.lit(0)))
    dealt = cut(keyed.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()))
    inside = F.sum("_v").over(W.partitionBy("_part", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    sums = dealt.groupBy("_part", *by).agg(F.sum("_v").alias("_s"))  # a row for each range and key in it
    whole = F.coalesce(F.sum("_s").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = sums.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_k_{c}") for c in by), whole.alias("_before"))
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by], F.col("_part") == F.col("_p"))
    out = dealt.withColumn("_inside", inside).join(before, same)
    return out.withColumn(name, F.col("_inside") + F.col("_before")).drop("_v", "_part", "_inside", "_before", "_p", *(f"_k_{c}" for c in by))


def numbered(rows: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "no") -> DataFrame:
    """rows with their number from 1 in the order given, within each key of `by` (or over all)."""
    return running_sum(rows, F.lit(1), order, by, name)
