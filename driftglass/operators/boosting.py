"""Boosted trees that can be continued, weights chosen on inner folds, and nested search.

Spark ML's boosted trees start from nothing. Here an ensemble is a base margin and a list of Spark ML regression trees,
each fitted to the gradients of the log loss at the margin so far, so that a fit may start from an ensemble's margin,
on other rows or weights: continuing an ensemble on the rows it was fitted on gives the trees of one longer fit.

Rows stay in Spark. Fits run one after another on the driver's word, as many as there are folds and settings; the
number of either is a parameter or bounded (``most_groups``), and more are refused rather than left out.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .estimation import prior_weights


@dataclass(frozen=True)
class Settings:
    trees: int = 10
    depth: int = 3
    rate: float = 0.3
    least: int = 1  # rows of a leaf
    seed: int = 7


@dataclass(frozen=True)
class Ensemble:
    features: tuple[str, ...]
    base: float
    rates: tuple[float, ...]
    trees: tuple[DecisionTreeRegressionModel, ...] = field(repr=False)

    def content_id(self) -> str:
        """A hash of all splits and values; the same trees have the same id in every session."""
        told = [t.toDebugString.split("\n", 1)[1] for t in self.trees]  # the first line names the object
        body = json.dumps([self.features, self.base, self.rates, told], separators=(",", ":"))
        return hashlib.sha256(body.encode()).hexdigest()

    def margin(self, rows: DataFrame, name: str) -> DataFrame:
        """Adds the log odds; rows with a missing feature get null."""
        whole = F.lit(True)
        for f in self.features:
            whole &= F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
        out = VectorAssembler(inputCols=list(self.features), outputCol="_vector", handleInvalid="keep").transform(rows)
        return self._added(out, 0, F.lit(self.base)).withColumn(name, F.when(whole, F.col("_margin"))).drop("_margin", "_vector")

    def _added(self, rows: DataFrame, first: int, start: Column) -> DataFrame:
        """``_margin``: ``start`` and what the trees from ``first`` on give, added one after another."""
        out, total = rows, start
        for k, (tree, rate) in enumerate(list(zip(self.trees, self.rates, strict=True))[first:]):
            out = tree.setFeaturesCol("_vector").setPredictionCol(f"_tree{k}").transform(out)
            total = total + rate * F.col(f"_tree{k}")
        return out.withColumn("_margin", total).drop(*(f"_tree{k}" for k in range(len(self.trees) - first)))

    def score(self, rows: DataFrame, name: str = "p") -> DataFrame:
        return self.margin(rows, "_log_odds").withColumn(name, 1 / (1 + F.exp(-F.col("_log_odds")))).drop("_log_odds")

    def save(self, path: str) -> None:
        for k, tree in enumerate(self.trees):
            tree.write().overwrite().save(f"{path}/tree-{k}")

    @classmethod
    def load(cls, path: str, features: Iterable[str], base: float, rates: Iterable[float]) -> Ensemble:
        rates = tuple(rates)
        return cls(tuple(features), base, rates, tuple(DecisionTreeRegressionModel.load(f"{path}/tree-{k}") for k in range(len(rates))))


def both_classes(rows: DataFrame, y: str) -> bool:
    return rows.where(F.col(y).isNotNull()).agg(F.count_distinct(y)).first()[0] > 1


def fit(rows: DataFrame, features: list[str], y: str = "y", weight: str | None = None, settings: Settings = Settings(), start: Ensemble | None = None) -> Ensemble:
    """Fits ``settings.trees`` trees, or adds as many to ``start``. Rows with a missing feature or label take no part; a
    table with one class is refused. Each tree's rows carry their margin in memory, or on disk where it is short."""
    if start is not None and tuple(features) != start.features:
        raise ValueError("an ensemble is continued on the features it was fitted on")
    label = F.col(y).cast("double").alias("_y")
    plain = rows.select(*(F.col(f).cast("double").alias(f) for f in features), label, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")).where("_y is not null")
    table = VectorAssembler(inputCols=features, outputCol="_vector", handleInvalid="skip").transform(plain).select("_vector", "_y", "_w").persist()
    kept = [table]
    try:
        totals = table.agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_y")).alias("wy"), F.count_distinct("_y").alias("n")).first()
        if totals.n < 2:
            raise ValueError("the rows hold a single class")
        base = start.base if start else _logit(totals.wy / totals.w)
        made = start or Ensemble(tuple(features), base, (), ())
        now = made._added(table, 0, F.lit(base)).persist()
        kept.append(now)
        for _ in range(settings.trees):
            number = len(made.trees)
            # the gradient in Newton steps of even odds
            target = now.withColumn("_g", 4 * (F.col("_y") - 1 / (1 + F.exp(-F.col("_margin")))))
            tree = DecisionTreeRegressor(featuresCol="_vector", labelCol="_g", weightCol="_w", maxDepth=settings.depth, minInstancesPerNode=settings.least, seed=settings.seed + number).fit(target)
            made = replace(made, rates=(*made.rates, settings.rate), trees=(*made.trees, tree))
            now = made._added(now.withColumnRenamed("_margin", "_before"), number, F.col("_before")).drop("_before").persist()
            kept.append(now)
            if len(kept) > 3:  # the table, the margin before and this one
                now.count()
                kept.pop(1).unpersist()
        return made
    finally:
        for df in kept:
            df.unpersist()


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def balanced(rows: DataFrame, y: str, rate: float, name: str = "weight") -> DataFrame:
    """Adds a weight that makes the weighted share of positives ``rate``."""
    return rows.join(F.broadcast(prior_weights(rows, y, rate).select(y, F.col("weight").alias(name))), y)


def groups_of(rows: DataFrame, group: str, most: int) -> list:
    """The values of a grouping column; over ``most`` of them are refused, as each is a fit."""
    found = sorted(r[0] for r in rows.select(group).where(F.col(group).isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"over {most} groups of {group}: one fit each")
    return found


def pooled_f1(scored: DataFrame, keys: list[str], y: str, p: str, at: float = 0.5) -> DataFrame:
    """(keys, f1, n_folds) over all folds' predictions together; null where it is undefined."""
    hit, said, is_ = F.col(p) >= at, F.col(p) >= at, F.col(y) == 1
    counts = scored.groupBy(*keys).agg(F.count_if(hit & is_).alias("tp"), F.count_if(said).alias("said"), F.count_if(is_).alias("real"), F.count_distinct("fold").alias("n_folds"))
    return counts.select(*keys, F.try_divide(2.0 * F.col("tp"), (F.col("said") + F.col("real")).cast("double")).alias("f1"), "n_folds")


def choose_weight(rows: DataFrame, target: Column, fold: str, grid: list[float], features: list[str], y: str = "y", settings: Settings = Settings(), adapt: Settings = Settings(trees=5), rate: float = 0.5, most_groups: int = 64, pooled: Ensemble | None = None) -> tuple[DataFrame, float, Ensemble]:
    """The weight of a target's own rows, chosen on inner folds.

    ``rows`` hold the other groups and the target's adaptation rows (``target``). The model of the others is continued
    on all of them, the adaptation rows weighing ``w`` times as much; each value of ``fold`` among the adaptation rows
    is held out in turn. Gives the predictions on inner folds ``(fold, w, y, p)``, the weight with the highest F1 over
    all of them together - the smallest of equals, and the smallest of all where F1 is defined nowhere - and the
    pooled model.
    """
    marked = rows.withColumn("_own", F.coalesce(target, F.lit(False)))
    pooled = pooled or fit(balanced(marked.where("not _own"), y, rate), features, y, "weight", settings)
    own = marked.where("_own")
    parts = []
    for held in groups_of(own, fold, most_groups):
        rest = marked.where(~(F.col("_own") & F.col(fold).eqNullSafe(F.lit(held))))
        if not both_classes(rest, y):
            continue
        for w in grid:
            weighted = balanced(rest, y, rate).withColumn("weight", F.col("weight") * F.when(F.col("_own"), w).otherwise(1.0))
            model = fit(weighted, features, y, "weight", adapt, start=pooled)
            parts.append(model.score(own.where(F.col(fold).eqNullSafe(F.lit(held)))).select(F.col(fold).cast("string").alias("fold"), F.lit(float(w)).alias("w"), F.col(y).alias("y"), "p"))
    found = _union(parts, rows.sparkSession, "fold string, w double, y double, p double")
    f1 = {r.w: r.f1 for r in pooled_f1(found, ["w"], "y", "p").collect()}  # one row for each weight of the grid
    return found, chosen_weight(grid, f1), pooled


def chosen_weight(grid: list[float], f1: dict[float, float | None]) -> float:
    """The weight with the highest F1, the smallest of equals; the smallest of all without any F1."""
    known = {w: f1[w] for w in grid if f1.get(w) is not None}
    return min(w for w in known if known[w] == max(known.values())) if known else min(grid)


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


Search = Callable[[int], Iterable[Settings]]


def random_search(trials: int, depths: tuple[int, int] = (1, 5), rates: tuple[float, float] = (0.1, 1.0), trees: tuple[int, int] = (2, 8)) -> Search:
    """A seeded search: ``trials`` settings, whole numbers evenly and rates evenly on a log scale."""

    def search(seed: int) -> Iterable[Settings]:
        r = random.Random(seed)
        for _ in range(trials):
            yield Settings(trees=r.randint(*trees), depth=r.randint(*depths), rate=round(rates[0] * (rates[1] / rates[0]) ** r.random(), 4), seed=seed)

    return search


def nested(rows: DataFrame, outer: str, inner: str, features: list[str], search: Search, y: str = "y", rate: float = 0.5, seed: int = 7, most_groups: int = 64) -> tuple[DataFrame, DataFrame]:
    """Held-out scores with settings searched inside each outer fold.

    Each value of ``outer`` is held out in turn. The search sees only the rows left: every trial is scored by the F1 of
    leave-one-out predictions over the values of ``inner`` among them (groups whose complement has one class are left
    out; fewer than two such groups give no F1), and the best - the first of equals, the first of all without any
    F1 - is fitted on all the rows left. Gives the scored rows with ``fold``, and a row for each trial:
    (fold, trial, settings as JSON, f1, n_folds, chosen).
    """
    spark, scored, trials = rows.sparkSession, [], []
    for held in groups_of(rows, outer, most_groups):
        train = rows.where(~F.col(outer).eqNullSafe(F.lit(held)))
        if not both_classes(train, y):
            continue
        tried = []
        for settings in search(seed):
            f1, n = inner_f1(train, inner, features, settings, y, rate, most_groups)
            tried.append((settings, f1, n))
        known = [f1 for _, f1, _ in tried if f1 is not None]
        best = next((k for k, t in enumerate(tried) if known and t[1] == max(known)), 0)
        trials += [(str(held), k, json.dumps(asdict(s), sort_keys=True), f1, n, k == best) for k, (s, f1, n) in enumerate(tried)]
        model = fit(balanced(train, y, rate), features, y, "weight", tried[best][0])
        scored.append(model.score(rows.where(F.col(outer).eqNullSafe(F.lit(held)))).withColumn("fold", F.lit(str(held))))
    record = spark.createDataFrame(trials, "fold string, trial int, settings string, f1 double, n_folds int, chosen boolean")
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return _union(scored, spark, f"{kinds}, p double, fold string"), record


def inner_f1(train: DataFrame, inner: str, features: list[str], settings: Settings, y: str, rate: float, most_groups: int) -> tuple[float | None, int]:
    """F1 over the leave-one-out predictions of all inner groups together, and their number."""
    parts = []
    for group in groups_of(train, inner, most_groups):
        own = F.col(inner).eqNullSafe(F.lit(group))
        rest = train.where(~own)
        if both_classes(rest, y):
            model = fit(balanced(rest, y, rate), features, y, "weight", settings)
            parts.append(model.score(train.where(own)).select(F.lit(str(group)).alias("fold"), F.col(y).alias("y"), "p"))
    if len(parts) < 2:
        return None, len(parts)
    r = pooled_f1(_union(parts, train.sparkSession, ""), [], "y", "p").first()
    return r.f1, r.n_folds
