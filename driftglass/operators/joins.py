"""Range, nearest and as-of joins as equi-joins on coarse buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _buckets(start: Column, stop: Column, width: float) -> Column:
    last = F.greatest(F.ceil(stop / width) - 1, F.floor(start / width))
    return F.explode(F.sequence(F.floor(start / width), last))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: float, how: str = "inner") -> DataFrame:
    """Pairs of left ``[start, stop)`` and right ``[r_start, r_stop)`` with positive overlap, and equal keys.

    Both sides are dealt to the buckets of ``width`` they touch; a pair is kept in the bucket where the later of the
    two starts lies, so no pair comes twice and nothing is made distinct. ``how``: inner, left_semi or left_anti
    (these need a column ``id`` on the left).
    """
    a = left.withColumn("_bucket", _buckets(F.col("start"), F.col("stop"), width))
    b = right.withColumn("_bucket", _buckets(F.col("r_start"), F.col("r_stop"), width))
    later = F.greatest("start", "r_start")
    pairs = a.join(b, [*keys, "_bucket"]).where((later < F.least("stop", "r_stop")) & (F.floor(later / width) == F.col("_bucket"))).drop("_bucket")
    if how == "inner":
        return pairs
    return left.join(pairs.select("id").distinct(), "id", how)


def as_of(rows: DataFrame, events: DataFrame, keys: list[str], width: float, forward: bool = False, strict: bool = False) -> DataFrame:
    """Adds ``e_t``, the time of the last event at or before each row's ``t`` (forward: the first at or after); strict:
    not at ``t`` itself. Times are told apart to the microsecond. Windows span one bucket of ``width``; the nearest event of the buckets beyond is carried in
    from a table with a row per bucket."""
    side = 1 if forward else -1
    bucket = F.floor(F.col("t") / width).alias("_b")
    here = rows.withColumn("_event", F.lit(None).cast("double")).withColumn("_b", bucket)
    there = events.select(*keys, F.col("t").cast("double").alias("t")).distinct().withColumn("_event", F.col("t")).withColumn("_b", bucket)
    both = here.withColumn("_row", F.lit(True)).unionByName(there.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    order = F.rint(F.col("t") * 1e6).cast("long") * side * -1
    frame = Window.partitionBy(*keys, "_b").orderBy(order)
    span = frame.rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    near = F.max("_event").over(span) if not forward else F.min("_event").over(span)
    edges = there.groupBy(*keys, "_b").agg((F.min("t") if forward else F.max("t")).alias("_edge"))
    around = Window.partitionBy(*keys).orderBy(F.col("_b") * -side).rowsBetween(Window.unboundedPreceding, -1)
    all_b = here.select(*keys, "_b").distinct().join(edges, [*keys, "_b"], "full")
    carried = all_b.withColumn("_carry", F.last("_edge", ignorenulls=True).over(around)).select(*keys, "_b", "_carry")
    found = both.withColumn("_near", near).where("_row").drop("_row", "_event")
    return found.join(carried, [*keys, "_b"], "left").withColumn("e_t", F.coalesce("_near", "_carry")).drop("_b", "_near", "_carry")


def nearest(rows: DataFrame, events: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Adds ``before``, ``after`` and ``distance`` (to the nearer, null without events)."""
    back = as_of(rows, events, keys, width).withColumnRenamed("e_t", "before")
    both = as_of(back, events, keys, width, forward=True).withColumnRenamed("e_t", "after")
    return both.withColumn("distance", F.least(F.col("t") - F.col("before"), F.col("after") - F.col("t")))
