"""Results that several plans read, written once to the folder that all executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> None:
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))


def cut(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint: computed once, its lineage cut. The folder is spark.checkpoint.dir; where all runs
    on one machine (tests) and it is unset, a temporary one."""
    _folder(df.sparkSession)
    return df.checkpoint()


def cut_as_dealt(df: DataFrame) -> DataFrame:
    """cut(), after which Spark still knows by which columns df is dealt out: a plan that adapts itself doesn't say."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    had = conf.get(name)
    conf.set(name, "false")
    try:
        return cut(df.select("*"))
    finally:
        conf.set(name, had)


def kept(df: DataFrame) -> DataFrame:
    """df in columns in the same folder, for texts: smaller than a checkpoint, and of it only the columns asked for are
    read. dropped() deletes it."""
    spark = df.sparkSession
    _folder(spark)
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got.kept_at = path
    return got


def dropped(df: DataFrame) -> None:
    """Deletes what kept() wrote, once all that reads it is written or cut itself."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
