"""Exact order statistics without holding a group.

Every wanted rank of a group has a range of values that holds it. In each round the rows in that range are counted in
bins of equal width, with the least and greatest value of each bin; the bin with the rank becomes the next range. It
ends when a range is a single value. The ends of a range always fall into different bins, so ranges shrink in every
round, usually to a value after a few. Tasks hold counters, never values; a group has at most ``bins`` rows a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.sources.shared import shared_folder, staged


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], bins: int = 1024) -> DataFrame:
    """(keys, share, n, quantile): between the two neighbouring order statistics, as ``percentile`` interpolates. Rows
    with a null or NaN value, or an infinite one, take no part; a group without others is not there."""
    names = [f"_key_{k}" for k in keys]
    x = F.col(value).cast("double")
    plain = rows.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), x.alias("v"))
    root = shared_folder(rows.sparkSession, "quantiles")

    place = (F.col("n") - 1) * F.col("share")
    each = plain.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = each.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares)))).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(place), F.ceil(place)))))
    state = staged(wanted.withColumn("below", F.lit(0).cast("long")), root, "round-0")
    k = 0
    while not state.where("lo < hi").isEmpty():
        k += 1
        state = staged(_narrowed(plain, state, names, bins), root, f"round-{k}")
    # at one or two ranks for each group and share
    w = F.col("n"), (F.col("n") - 1) * F.col("share")
    low = F.min(F.struct("rank", "lo"))
    high = F.max(F.struct("rank", "lo"))
    found = state.groupBy(*names, "share").agg(F.first("n").alias("n"), low.alias("a"), high.alias("b"))
    at = w[1]
    between = (F.col("b.rank") - at) * F.col("a.lo") + (at - F.col("a.rank")) * F.col("b.lo")
    quantile = F.when(F.col("a.rank") == F.col("b.rank"), F.col("a.lo")).otherwise(between)
    return found.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), "share", "n", quantile.alias("quantile"))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """The state with each open range cut to the bin that holds its rank."""
    is_open = state.where("lo < hi")
    same = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    other = is_open.select(*(F.col(k).alias(f"_{k}") for k in keys), "lo", "hi").distinct()
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = rows.join(other, same)
    # halves, as the width of a range may be beyond the largest number
    width = F.col("hi") / 2 - F.col("lo") / 2
    bin_ = F.when(F.col("v") == F.col("hi"), bins).when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * bins).cast("int"))).otherwise(0)
    counts = inside.withColumn("bin", bin_).groupBy(*keys, "lo", "hi", "bin").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = counts.withColumn("before", before).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "c", "least", "most", "before")
    mine = (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("rank") - F.col("below") >= F.col("before")) & (F.col("rank") - F.col("below") < F.col("before") + F.col("c"))
    for k in keys:
        mine &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    cut = is_open.join(told, mine).select(*keys, "n", F.col("least").alias("lo"), F.col("most").alias("hi"), "share", "rank", (F.col("below") + F.col("before")).alias("below"))
    return cut.unionByName(state.where("lo = hi"))
