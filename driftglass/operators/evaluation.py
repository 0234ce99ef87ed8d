"""Evaluation: confusion counts, calibration, group leakage and verdicts. Undefined ratios are null and pass nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftglass.functions.robust import ratio


def confusion(rows: DataFrame, truth: str, predicted: Column, by: str) -> DataFrame:
    """Counts, precision, recall and F1 per group and over all (``all``): counts are summed before dividing."""
    y = F.col(truth) == 1
    cells = {"tp": y & predicted, "fp": ~y & predicted, "fn": y & ~predicted, "tn": ~y & ~predicted}
    sets = rows.groupingSets([[by], []], by).agg(*(F.count_if(c).alias(n) for n, c in cells.items()))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sets.select(F.coalesce(by, F.lit("all")).alias("scope"), *cells, F.round(ratio(tp, tp + fp), 6).alias("prec"), F.round(ratio(tp, tp + fn), 6).alias("rec"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def reliability(rows: DataFrame, p: str, truth: str, bins: int = 10) -> DataFrame:
    """Mean predicted and observed per equal-width bin, and the expected calibration error; empty bins do not count."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(p)))
    g = rows.groupBy(F.least(F.floor(clipped * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(truth).alias("mean_y"))
    error = g.agg(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).scalar()
    return g.withColumn("ece", error)


def eta_squared(rows: DataFrame, value: str, group: str, limit: float = 0.999) -> DataFrame:
    """Share of the variance that lies between groups of two or more."""
    x = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("x"))
    means = x.groupBy("g").agg(F.count("*").alias("k"), F.avg("x").alias("m")).where("k >= 2")
    kept = x.join(means, "g")
    within = kept.agg(F.count("*").alias("n"), F.sum((F.col("x") - F.col("m")) ** 2).alias("w"), (F.var_pop("x") * F.count("*")).alias("t"))
    eta = 1 - ratio(F.col("w"), F.col("t"))
    return within.select("n", eta.alias("eta2"), (eta >= limit).alias("leaks"))


def status(passed: Column, missing: Column | None = None) -> Column:
    """pass, fail, or not computable where the input or the comparison is missing."""
    gap = passed.isNull() if missing is None else passed.isNull() | missing
    return F.when(gap, "not computable").when(passed, "pass").otherwise("fail")
