"""Event-sourced state: replay of an append-only log, in a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay(log: DataFrame, key: str, action: str, at: str, tie: str, origin: str, carried: str) -> DataFrame:
    """(key, state, <origin>_us, carried, n): the latest action, and what the last origin action set. Aggregates only,
    so the order of arrival does not matter and the same works in a streaming query in update mode."""
    order = F.struct(at, tie)
    first = F.col(action) == origin
    return log.groupBy(key).agg(F.max_by(action, order).alias("state"), F.max(F.when(first, F.col(at))).alias(f"{origin}_us"), F.max_by(F.when(first, F.col(carried)), F.when(first, order)).alias("carried"), F.count("*").alias("n"))
