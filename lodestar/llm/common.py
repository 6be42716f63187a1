"""Reading tables and cutting lineage, shared by the operators of this subpackage."""

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's settings of batches between the JVM and Python: its default, and what is better for long texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_batches(spark: SparkSession) -> None:
    """Batches of few rows and bytes, which bounds what a task holds, where the session keeps to Spark's defaults."""
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where all runs on one machine (tests) may it be
    unset, and is a temporary one then."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    got = spark.sparkContext.getCheckpointDir()
    if not got:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        got = spark.sparkContext.getCheckpointDir()
    return got


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Folders written by stored() that are still there.
held: list[str] = []


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: columnar and compressed, so smaller than a
    checkpoint. discard() or release() deletes it."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    held.append(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.stored_at = path
    return got


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these, once all that reads them is itself written or checkpointed."""
    release(frames[0].sparkSession, [df.stored_at for df in frames])


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes these folders that stored() wrote."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in held:
            held.remove(path)


#: beside() sends at most so many rows to all tasks, and else deals each key's rows to so many places.
BROADCAST, SALTS = 50_000, 16


def beside(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows with the columns of facts (at most one row a key; small ones), null where there is none. However many rows
    a key has, they aren't brought to one task. Null keys have no facts."""
    if facts.limit(BROADCAST + 1).count() <= BROADCAST:
        return rows.join(F.broadcast(facts), key, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"], "left").drop("_salt")
