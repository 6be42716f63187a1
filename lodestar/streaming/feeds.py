"""The engine's tables kept current by streams."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import audit, latest, sessions


def read_feed(spark: SparkSession, path: str, schema) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)


def debounced(feed: DataFrame, at: str, by: list[str], gap: str, late: str) -> DataFrame:
    """Sessions of a stream, given out once no event within `late` can still join them."""
    return sessions(feed.withWatermark(at, late), at, by, gap)


def audit_stream(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """audit() of a stream of calls; a day is final once `late` has passed."""
    day = F.window("ts", "1 day").alias("w")
    rows = calls.withWatermark("ts", late)
    return rows.groupBy(F.col("event_type").alias("tool"), day).agg(F.count("*").alias("calls"), F.count_if(F.col("value") < 10).alias("failed")).select("tool", F.col("w.start").alias("day"), "calls", "failed")


def keep_current(feed: DataFrame, key: str, seq: str, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's last change of each key to the folder `target`, a folder a batch, and ends when what is
    there has been read. current() gives the state. A batch that is run again after a loss overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, seq).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: str, seq: str, removed: str | None = None) -> DataFrame:
    """The state after all batches of keep_current(), without keys whose last change says so in the column `removed`."""
    state = latest(spark.read.parquet(target).drop("batch"), key, seq)
    return state if removed is None else state.where(~F.coalesce(F.col(removed), F.lit(False)))


def compact(spark: SparkSession, target: str, key: str, seq: str) -> None:
    """Leaves one folder with the last change of each key in place of all there are, so that current() reads no more
    than the state. Not while keep_current() runs. Merged rows get a folder with a number below zero, which no batch has,
    so a batch that is run again replaces none of them. The folder appears whole by one rename before an old one goes,
    and repeated rows don't count, so a run that is broken off loses nothing and can be run again."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    old = [x.getPath() for x in fs.listStatus(path(target)) if x.getPath().getName().startswith("batch=")]
    if len(old) < 2:
        return
    least = min(0, *(int(x.getName().split("=")[1]) for x in old))
    latest(spark.read.parquet(target).drop("batch"), key, seq).write.mode("overwrite").parquet(f"{target}/_merged")
    if not fs.rename(path(f"{target}/_merged"), path(f"{target}/batch={least - 1}")):
        raise RuntimeError(f"could not rename to batch={least - 1}")
    for folder in old:
        fs.delete(folder, True)


__all__ = ["audit", "audit_stream", "compact", "current", "debounced", "keep_current", "read_feed"]
