"""Models over labelled tables: weighted boosted trees, folds by group, calibration, and records of what was fitted.

Fits are Spark ML on DataFrames; no rows come to the driver. A run's settings are hashed before it is used, and every
scored row carries the model's content id.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .estimation import prior_weights


def weighted(rows: DataFrame, y: str, rate: float) -> DataFrame:
    """Adds ``weight`` so that the weighted share of positives equals ``rate``."""
    return rows.join(F.broadcast(prior_weights(rows, y, rate).select(y, "weight")), y)


def boosted(features: list[str], y: str = "y", trees: int = 10, depth: int = 3, seed: int = 7) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    trees_ = GBTClassifier(featuresCol="_features", labelCol=y, weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[assembler, trees_.setProbabilityCol("_p").setRawPredictionCol("_raw")])


def scores(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("_p")[1]).drop("_features", "_p", "_raw", "prediction")


def model_id(settings: dict) -> str:
    """Content id of settings as canonical JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def folds(rows: DataFrame, group: str, n: int) -> DataFrame:
    """Adds ``fold``: groups are never split."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(n)).cast("int"))


def tuned(rows: DataFrame, features: list[str], group: str, n_folds: int, depths: list[int], y: str = "y") -> CrossValidatorModel:
    """Cross-validation over tree depths with folds by group."""
    pipeline = boosted(features, y)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[1].maxDepth, depths).build()
    judge = BinaryClassificationEvaluator(labelCol=y, rawPredictionCol="_raw")
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=judge, numFolds=n_folds, foldCol="fold", parallelism=2).fit(folds(rows, group, n_folds))


def leave_one_out(rows: DataFrame, features: list[str], group: str, targets: list[str], rate: float, y: str = "y", trees: int = 5) -> DataFrame:
    """Held-out scores: for each target group a model of all the others. The targets are parameters, one fit each."""
    out = None
    for target in targets:
        train = rows.where(F.col(group) != target)
        if not train.where(F.col(group) == target).isEmpty():
            raise ValueError("a target's rows are in its own training side")
        model = boosted(features, y, trees).fit(weighted(train, y, rate))
        part = scores(model, rows.where(F.col(group) == target)).withColumn("model", F.lit(model_id({"features": features, "target": target, "trees": trees})))
        out = part if out is None else out.unionByName(part)
    return out


def adapted(rows: DataFrame, features: list[str], group: str, targets: list[str], admitted: Column, rate: float, boost: float = 3.0, y: str = "y", trees: int = 5) -> DataFrame:
    """Scores of each target's rows by a model of all the other groups and of the target's own ``admitted`` rows, which
    weigh ``boost`` times as much; ``status`` says which rows were admitted, and those are not scored. A target whose
    admitted rows lack a class is ``refused`` and gets no model."""
    marked = rows.withColumn("_in", F.coalesce(admitted, F.lit(False)))
    both = marked.where("_in").groupBy(group).agg(F.countDistinct(y).alias("n")).where("n > 1")
    able = {r[group] for r in both.where(F.col(group).isin(targets)).collect()}
    out = None
    for target in targets:
        own = marked.where(F.col(group) == target)
        status = F.when(F.col("_in"), "admitted").otherwise("scored" if target in able else "refused")
        part = own.withColumn("p", F.lit(None).cast("double")).withColumn("model", F.lit(None).cast("string"))
        if target in able:
            others = weighted(marked.where(F.col(group) != target), y, rate)
            train = others.unionByName(weighted(own.where("_in"), y, rate).withColumn("weight", F.col("weight") * boost))
            fitted = scores(boosted(features, y, trees).fit(train), own.where("not _in"))
            name = model_id({"features": features, "target": target, "trees": trees, "boost": boost})
            part = fitted.withColumn("model", F.lit(name)).unionByName(part.where("_in"))
        part = part.withColumn("status", status).drop("_in")
        out = part if out is None else out.unionByName(part)
    return out


def platt(rows: DataFrame, p: str, y: str) -> tuple[float, float]:
    """(slope, intercept) of a logistic fit on the logit."""
    clipped = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    x = VectorAssembler(inputCols=["_l"], outputCol="_x").transform(rows.withColumn("_l", F.log(clipped / (1 - clipped))))
    fit = LogisticRegression(featuresCol="_x", labelCol=y).fit(x)
    return float(fit.coefficients[0]), float(fit.intercept)


def isotonic_calibrated(rows: DataFrame, p: str, y: str) -> DataFrame:
    """Adds ``calibrated`` from an isotonic fit, clipped to [0, 1]."""
    model = IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="calibrated").fit(rows)
    return model.transform(rows).withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("calibrated"))))


def crossfit(rows: DataFrame, p: str, y: str, group: str, bins: int = 20) -> DataFrame:
    """Adds ``crossfit``: the rate of positives in a row's bin over all groups but its own, by totals less own sums."""
    binned = rows.withColumn("_bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    own, all_ = Window.partitionBy(group, "_bin"), Window.partitionBy("_bin")
    n = F.count("*").over(all_) - F.count("*").over(own)
    k = F.sum(y).over(all_) - F.sum(y).over(own)
    return binned.withColumn("crossfit", F.try_divide(k.cast("double"), n.cast("double"))).drop("_bin")


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], y: str, seed: int = 7) -> DataFrame:
    """(feature, drop): mean squared error gained when a feature takes the value of another row: the next in the hash order
    of a block of some 10,000 rows, the first of the block for its last."""
    spark, base, blocks = rows.sparkSession, _error(model, rows, y), rows.count() // 10_000 + 1
    found = []
    for f in features:
        h = F.xxhash64(F.lit(seed), F.lit(f), *features)
        w = Window.partitionBy(F.pmod(F.xxhash64(h), F.lit(blocks))).orderBy(h)
        moved = rows.withColumn(f, F.coalesce(F.lead(f, 1).over(w), F.first(f).over(w)))
        found.append((f, _error(model, moved, y) - base))
    return spark.createDataFrame(found, "feature string, drop double")


def _error(model: PipelineModel, rows: DataFrame, y: str) -> float:
    return scores(model, rows).agg(F.avg((F.col("p") - F.col(y)) ** 2)).first()[0]
