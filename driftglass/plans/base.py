"""Registration of queries, and the carrier tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.functions.robust import log_envelope, reference, robust_z

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
STEP_S = 3600


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``us``, microseconds since 1970."""
    return table(spark, sf_dir, "events").withColumn("us", F.expr("unix_micros(cast(ts as timestamp))"))


def frames(spark: SparkSession, sf_dir: str, step_s: int = STEP_S) -> DataFrame:
    """(signal, frame, rms): root mean square of the values in each frame; frames without events are not assessable."""
    e = events(spark, sf_dir).select(F.col("event_type").alias("signal"), F.expr(f"us div {step_s * 1_000_000}").alias("frame"), "value")
    return e.groupBy("signal", "frame").agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def scored(spark: SparkSession, sf_dir: str, step_s: int = STEP_S, least: int = 100) -> DataFrame:
    """(signal, frame, rms, x, z): frames scored against their own signal."""
    x = frames(spark, sf_dir, step_s).withColumn("x", log_envelope(F.col("rms")))
    return robust_z(x, reference(x, ["signal"], "x", least), ["signal"], "x")


# The same carriers in SQL.
FRAMES = "frames AS (SELECT event_type AS signal, epoch_us(ts) // 3600000000 AS frame, sqrt(avg(value * value)) AS rms FROM events GROUP BY 1, 2)"
LOGS = f"{FRAMES}, logs AS (SELECT *, ln(greatest(rms, 1e-12)) AS x FROM frames)"
REFS = f"{LOGS}, mids AS (SELECT signal, quantile_cont(x, 0.5) AS center, count(x) AS n FROM logs GROUP BY 1), refs AS (SELECT l.signal, any_value(center) AS center, any_value(n) AS n, 1.4826 * quantile_cont(abs(x - center), 0.5) AS scale FROM logs l JOIN mids USING (signal) GROUP BY 1)"
SCORED = f"{REFS}, scored AS (SELECT l.*, (x - center) / scale AS z FROM logs l LEFT JOIN refs r ON l.signal = r.signal AND scale >= 1e-6 AND n >= 100)"
