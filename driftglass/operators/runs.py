"""Runs, hysteresis and interval algebra.

A long series is cut into blocks of its order column. Runs and merges are first made inside the blocks, where windows
are short and spread over the cluster, and then joined over the block edges by a second window that sees runs, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of the order column in one block.
BLOCK = 4096


def true_runs(df: DataFrame, keys: list[str], at: str, block: int = BLOCK, **members: Column) -> DataFrame:
    """Half-open runs ``[start, stop)`` of consecutive integers ``at`` per key; ``members`` are aggregates over a
    run's rows that can be aggregated again under the same name by max (flags, maxima)."""
    blocks = df.withColumn("_b", F.expr(f"{at} div {block}"))
    inner = Window.partitionBy(*keys, "_b").orderBy(at)
    parts = blocks.withColumn("_g", F.col(at) - F.row_number().over(inner)).groupBy(*keys, "_b", "_g").agg(F.min(at).alias("start"), (F.max(at) + 1).alias("stop"), *(c.alias(n) for n, c in members.items()))
    return join_runs(parts.drop("_b", "_g"), keys, F.lit(0), list(members))


def join_runs(runs: DataFrame, keys: list[str], gap: Column, members: list[str] = (), strict: bool = False) -> DataFrame:
    """Merges runs whose distance is at most ``gap`` (below it if ``strict``), over all rows of a key."""
    w = Window.partitionBy(*keys).orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    distance = F.col("start") - before
    apart = ~F.coalesce(distance < gap if strict else distance <= gap, F.lit(False))
    grouped = runs.withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), *(F.max(n).alias(n) for n in members)).drop("_run")


def merge_intervals(intervals: DataFrame, keys: list[str], gap: float = 0, strict: bool = False, block: float | None = None) -> DataFrame:
    """Union of intervals ``[start, stop)`` per key. With ``block``, merged inside blocks of start first."""
    if block:
        local = intervals.withColumn("_b", F.floor(F.col("start") / block))
        intervals = join_runs(local, [*keys, "_b"], F.lit(gap), strict=strict).drop("_b")
    return join_runs(intervals, keys, F.lit(gap), strict=strict)


def hysteresis(df: DataFrame, keys: list[str], at: str, enter: Column, leave: Column, block: int = BLOCK, **members: Column) -> DataFrame:
    """Runs of ``leave`` that hold a row with ``enter``; both are null-safe flags."""
    flagged = df.where(F.coalesce(leave, F.lit(False))).withColumn("_enter", F.coalesce(enter, F.lit(False)))
    return true_runs(flagged, keys, at, block, _enter=F.max("_enter"), **members).where("_enter").drop("_enter")


def complement(intervals: DataFrame, bounds: DataFrame, keys: list[str], block: float | None = None) -> DataFrame:
    """Gaps ``[start, stop)`` of each key's bounds ``[lo, hi)`` that the merged intervals leave."""
    merged = merge_intervals(intervals, keys, block=block)
    w = Window.partitionBy(*keys).orderBy("start")
    inner = merged.join(bounds, keys).select(*keys, "lo", "hi", F.greatest("start", "lo").alias("start"), F.least("stop", "hi").alias("stop")).where("start < stop")
    between = inner.select(*keys, F.coalesce(F.lag("stop").over(w), F.col("lo")).alias("a"), F.col("start").alias("b"))
    last = inner.groupBy(*keys).agg(F.max("stop").alias("a"), F.first("hi").alias("b"))
    free = bounds.join(inner.select(*keys).distinct(), keys, "left_anti").select(*keys, F.col("lo").alias("a"), F.col("hi").alias("b"))
    return between.unionByName(last).unionByName(free).where("a < b").select(*keys, F.col("a").alias("start"), F.col("b").alias("stop"))


def union_length(intervals: DataFrame, keys: list[str], block: float | None = None) -> DataFrame:
    """(keys, length). With ``block``, intervals are cut at the blocks' edges and merged inside them, so that no window
    holds a whole key's intervals."""
    length = F.sum(F.col("stop") - F.col("start")).alias("length")
    if not block:
        return merge_intervals(intervals, keys).groupBy(*keys).agg(length)
    last = F.greatest(F.floor(F.col("start") / block), F.ceil(F.col("stop") / block) - 1)
    cut = intervals.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    edge = {"start": F.greatest("start", F.col("_b") * block), "stop": F.least("stop", (F.col("_b") + 1) * block)}
    return join_runs(cut.withColumns(edge), [*keys, "_b"], F.lit(0)).groupBy(*keys).agg(length)
