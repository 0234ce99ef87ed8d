"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir`` of the session; only where that is unset, as in tests on one
    machine, below a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="driftglass-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root}/driftglass-{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def staged(df: DataFrame, root: str, name: str) -> DataFrame:
    """The rows written below ``root`` and read from there: what is used several times is worked out once, and a lost
    executor costs a re-read."""
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")
