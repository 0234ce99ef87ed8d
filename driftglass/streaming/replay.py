"""Streaming twins: the event log as a stream, with state kept by Spark and checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from driftglass.operators.log import replay


def log_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a log folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def replayed(log: DataFrame, key: str, action: str, at: str, tie: str, origin: str, carried: str) -> DataFrame:
    """The replay as a stream in update mode: the same aggregates as the batch, so events may come in any order."""
    return replay(log, key, action, at, tie, origin, carried)


def windowed_rates(log: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts, means and peaks per fixed window; a window is final once the watermark has passed it."""
    w = F.window(time, width)
    return log.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("top")).select(F.col("window.start").alias("start"), *keys, "n", "mean", "top")


def sessions(log: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per key that end after a gap, the streaming form of merging intervals."""
    w = F.session_window(time, gap)
    return log.withWatermark(time, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n")


def to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, mode: str = "append") -> StreamingQuery:
    """Writes a stream to Parquet, all that is there now. In update mode each batch adds a version folder with the
    latest rows of its keys; a batch that runs again after a failure replaces its own folder."""
    if mode == "append":
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def upsert(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return stream.writeStream.outputMode(mode).foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows of the last version of each key."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "version").alias("r")).select(key, "r.*")
