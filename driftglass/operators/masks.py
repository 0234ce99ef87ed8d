"""Validity masks per consumer and signal, kept as runs: a mask costs a row per invalid span and none per frame."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import runs as R


def build(spans: DataFrame, dims: DataFrame, bounds: DataFrame) -> DataFrame:
    """Every (consumer, signal) of ``dims`` with its merged invalid spans clipped to the bounds; one without spans has
    a row with nulls, and all of it is valid. Consumers are never merged."""
    merged = R.merge_intervals(spans, ["signal"], block=R.BLOCK)
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    return dims.join(merged, "signal", "left").select("consumer", "signal", F.greatest("start", F.when(F.col("start").isNotNull(), lo)).alias("start"), F.least("stop", F.when(F.col("stop").isNotNull(), hi)).alias("stop"), lo.alias("lo"), hi.alias("hi"))


def totals(masks: DataFrame) -> DataFrame:
    return masks.groupBy("consumer", "signal").agg(F.max(F.col("hi") - F.col("lo")).alias("n_frames"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("n_invalid"))


def hold(rows: DataFrame, share_col: str, share: float = 0.2, times: float = 3.0, floor: float = 0.01, least_kept: float | None = None, group: list[str] = ()) -> DataFrame:
    """Rows to hold back with ``reasons``; the median is that of the row's group."""
    f = F.col(share_col)
    if group:
        with_median = rows.join(rows.groupBy(*group).agg(F.percentile(share_col, F.lit(0.5)).alias("_med")), list(group))
    else:
        with_median = rows.withColumn("_med", rows.agg(F.percentile(share_col, F.lit(0.5))).scalar())
    checks = [(f > share, "above share"), (f > times * F.greatest("_med", F.lit(floor)), "above median")]
    if least_kept is not None:
        checks.append((1 - f < least_kept, "low retention"))
    reasons = F.filter(F.array(*(F.when(c, F.lit(why)) for c, why in checks)), lambda x: x.isNotNull())
    return with_median.withColumn("reasons", reasons).where(F.size("reasons") > 0).drop("_med")


def taper(distance: Column, length: int) -> Column:
    """Raised-cosine weight at a distance (from 0) outside a masked run."""
    return 0.5 * (1 - F.cos(pi * (distance + 1) / (length + 1)))
