"""Estimates from sums: fits by normal equations, aligned averages, rank correlations, bootstrap and calibration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.functions.robust import correlation, ratio


def combine(rows: DataFrame, recipe: dict[str, float], member: str, keys: list[str], value: str) -> DataFrame:
    """(keys, x, members): the weighted sum where all members are present. The recipe is a parameter."""
    weights = F.create_map(*(F.lit(v) for pair in recipe.items() for v in pair))
    inside = rows.where(F.col(member).isin(list(recipe)))
    return inside.groupBy(*keys).agg(F.sum(F.element_at(weights, F.col(member)) * F.col(value)).alias("x"), F.count(value).alias("members")).where(F.col("members") == len(recipe))


def two_regressors(rows: DataFrame, y: str, a: str, b: str) -> DataFrame:
    s = rows.agg(*(F.sum(F.col(p) * F.col(q)).alias(f"_{n}") for n, p, q in (("aa", a, a), ("ab", a, b), ("bb", b, b), ("ay", a, y), ("by", b, y))), F.count("*").alias("n"))
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    return s.select(ratio(F.col("_ay") * F.col("_bb") - F.col("_by") * F.col("_ab"), det).alias("k1"), ratio(F.col("_by") * F.col("_aa") - F.col("_ay") * F.col("_ab"), det).alias("k2"), "n")


def weighted_line(rows: DataFrame, x: Column, y: Column, w: Column, least_dof: int = 10) -> DataFrame:
    """(slope, icept, n, usable) of y on x with weights."""
    d = rows.select(x.alias("x"), y.alias("y"), w.alias("w")).dropna()
    s = d.agg(*(F.sum(e).alias(n) for n, e in (("sw", F.col("w")), ("sx", F.col("w") * F.col("x")), ("sy", F.col("w") * F.col("y")), ("sxx", F.col("w") * F.col("x") ** 2), ("sxy", F.col("w") * F.col("x") * F.col("y")))), F.count("*").alias("n"))
    det = F.col("sw") * F.col("sxx") - F.col("sx") ** 2
    return s.select(ratio(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), det).alias("slope"), ratio(F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy"), det).alias("icept"), "n", ((F.col("n") - 2 >= least_dof) & (det > 1e-9)).alias("usable"))


def aligned(series: DataFrame, at: DataFrame, time: str, value: str, keys: list[str], half: int) -> DataFrame:
    """(keys, lag, mean, se, n) of a series around events ``at``: events are sent to the ``2 half + 1`` times they meet."""
    lags = at.select("at", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("lag")).withColumn(time, F.col("at") + F.col("lag"))
    return series.join(lags.select(time, F.col("lag").cast("long").alias("lag")), time).groupBy(*keys, "lag").agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"))


def autocorrelation(series: DataFrame, keys: list[str], time: str, value: str, most: int) -> DataFrame:
    """(keys, lag, r) for lags from 1 to ``most``."""
    c = series.withColumn("_x", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))
    var = c.groupBy(*keys).agg(F.avg(F.col("_x") ** 2).alias("_v"))
    moved = c.select(*keys, F.col("_x").alias("_y"), F.col(time).alias("_t"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("lag")).withColumn(time, F.col("_t") - F.col("lag"))
    pairs = c.select(*keys, time, "_x").join(moved.select(*keys, time, "lag", "_y"), [*keys, time])
    return pairs.groupBy(*keys, "lag").agg(F.avg(F.col("_x") * F.col("_y")).alias("_c")).join(var, keys).select(*keys, F.col("lag").cast("long").alias("lag"), ratio(F.col("_c"), F.col("_v")).alias("r"))


def spearman(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, rho, n): correlation of mid-ranks. Ranks come from counts per value, so ties cost nothing."""
    w = Window.partitionBy(*keys)
    mid = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0
    ranked = rows.select(*keys, mid(a).alias("_a"), mid(b).alias("_b"))
    return ranked.groupBy(*keys).agg(correlation(F.col("_a"), F.col("_b")).alias("rho"), F.count("*").alias("n"))


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation through the points; constant beyond the last, null below the first."""
    out = F.when(x >= points[-1][0], F.lit(points[-1][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when((x >= x0) & (x < x1), y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    return out


def prior_weights(rows: DataFrame, y: str, rate: float) -> DataFrame:
    g = rows.groupBy(y).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return g.select(y, "n", (F.when(F.col(y) == 1, rate).otherwise(1 - rate) * total / F.col("n")).alias("weight"))


def cluster_bootstrap(clusters: DataFrame, cluster: str, hit: str, total: str, draws: int, confidence: float = 0.95) -> DataFrame:
    """(lo, hi, draws): percentile interval of sum(hit) / sum(total) over reweighted clusters. Weights 0, 1 or 2 come
    from a hash of cluster and draw, so any engine draws the same; undefined draws are skipped."""
    weight = F.conv(F.substring(F.md5(F.concat_ws(":", cluster, F.col("d").cast("string")).cast("binary")), 1, 4), 16, 10).cast("int") % 3
    each = clusters.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_k", weight)
    r = each.groupBy("d").agg(ratio(F.sum(F.col("_k") * F.col(hit)), F.sum(F.col("_k") * F.col(total))).alias("r"))
    side = (1 - confidence) / 2
    return r.agg(F.percentile("r", F.lit(side)).alias("lo"), F.percentile("r", F.lit(1 - side)).alias("hi"), F.count("r").alias("draws"))


def isotonic(bins: DataFrame, at: str, mean: str, weight: str) -> DataFrame:
    """(at, fit): the increasing fit of weighted means, pooling adjacent violators. ``bins`` is a table of fixed length,
    folded as one array."""
    row = bins.agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("b"), F.col(mean).cast("double").alias("m"), F.col(weight).cast("double").alias("w")))).alias("_r"))
    empty = F.array().cast("array<struct<bs: array<int>, m: double, w: double>>")

    def pool(stack: Column) -> Column:
        last, prev = F.element_at(stack, -1), F.element_at(stack, -2)
        w = last["w"] + prev["w"]
        joined = F.struct(F.concat(prev["bs"], last["bs"]).alias("bs"), ((last["m"] * last["w"] + prev["m"] * prev["w"]) / w).alias("m"), w.alias("w"))
        falls = (F.size(stack) >= 2) & (F.try_element_at(stack, F.lit(-2))["m"] >= last["m"])
        return F.when(falls, F.concat(F.slice(stack, 1, F.size(stack) - 2), F.array(joined))).otherwise(stack)

    def step(stack: Column, x: Column) -> Column:
        grown = F.concat(stack, F.array(F.struct(F.array(x["b"]).alias("bs"), x["m"].alias("m"), x["w"].alias("w"))))
        return F.aggregate(F.sequence(F.lit(1), F.size(grown)), grown, lambda acc, _: pool(acc))

    blocks = row.select(F.explode(F.aggregate("_r", empty, step)).alias("x"))
    return blocks.select(F.explode("x.bs").alias(at), F.col("x.m").alias("fit"))


def permutation_sums(rows: DataFrame, keys: list[str], value: str, draws: int) -> DataFrame:
    """(keys, d, total): sums of the values under hash-drawn signs, for sign-permutation tests."""
    each = rows.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    sign = F.when(F.pmod(F.xxhash64(*keys, value, "d"), F.lit(2)) == 0, 1).otherwise(-1)
    return each.groupBy(*keys, "d").agg(F.sum(sign * F.col(value)).alias("total"))


def stack_rows(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
