"""A registry of fitted ensembles on the shared file system.

A model lies in a folder named by its content id: its trees, and one row with its spec and provenance as JSON. It is
written once; the same id with another spec is refused. An event log of JSON lines is only added to. Loading checks the
content id again. A model is applied only where it may be: to rows of its feature version, to its own group unless it is
pooled, and never to evaluation rows if it was adapted with a test group's own rows.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.sources.files import append_lines, read_lines
from driftglass.sources.shared import exists

from .boosting import Ensemble

POOLED, OWN, ADAPTED = "pooled", "own", "adapted"
EVENT = "at timestamp, user string, action string, model_id string, mode string, group string, feature_version string"


class NotApplicableError(ValueError):
    pass


@dataclass(frozen=True)
class Spec:
    model_id: str
    mode: str
    group: str | None
    feature_version: str
    corpus_hash: str
    never_scores_evaluation: bool = False


def register(spark: SparkSession, root: str, model: Ensemble, spec: Spec, user: str, provenance: dict) -> str:
    """Writes a model once and logs it; gives its id. The spec must name the model's content id, and the provenance must
    carry the spec."""
    if spec.mode not in (POOLED, OWN, ADAPTED) or (spec.mode == POOLED) != (spec.group is None):
        raise ValueError("a pooled model has no group, another has one")
    if spec.model_id != model.content_id():
        raise ValueError("the spec names another model's content id")
    if provenance.get("spec") != asdict(spec):
        raise ValueError("the provenance does not carry this spec")
    if spec.never_scores_evaluation and not provenance.get("evaluation_rows_checked"):
        raise ValueError("an adapted model of a test group needs a checked separation from its evaluation rows")
    path = f"{root}/models/{spec.model_id}"
    if exists(spark, f"{path}/record"):
        if spec_of(spark, root, spec.model_id) != spec:
            raise ValueError("the model is there with another spec; models do not change")
        return spec.model_id
    model.save(path)
    told = {"spec": asdict(spec), "provenance": provenance, "features": list(model.features), "base": model.base, "rates": list(model.rates)}
    # the record is written last: a model without one was not finished and is not there
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/record")
    event = (user, "trained", spec.model_id, spec.mode, spec.group, spec.feature_version)
    append_lines(spark.createDataFrame([event], EVENT.split(", ", 1)[1]).select(F.current_timestamp().alias("at"), "*"), f"{root}/log")
    return spec.model_id


def _record(spark: SparkSession, root: str, model_id: str) -> dict:
    path = f"{root}/models/{model_id}/record"
    if not exists(spark, path):
        raise KeyError(f"no model {model_id}")
    return json.loads(spark.read.text(path).first()[0])


def spec_of(spark: SparkSession, root: str, model_id: str) -> Spec:
    return Spec(**_record(spark, root, model_id)["spec"])


def load(spark: SparkSession, root: str, model_id: str) -> tuple[Ensemble, Spec]:
    told = _record(spark, root, model_id)
    model = Ensemble.load(f"{root}/models/{model_id}", told["features"], told["base"], told["rates"])
    if model.content_id() != model_id:
        raise ValueError("the stored model is not the one its id names")
    return model, Spec(**told["spec"])


def write_run_record(spark: SparkSession, root: str, name: str, settings: dict) -> str:
    """Writes a run's settings - thresholds, grids, tuning - before it starts, and gives their hash. A record is written
    once; the same name with other settings is refused."""
    body = json.dumps(settings, sort_keys=True, separators=(",", ":"))
    path = f"{root}/runs/{name}"
    if exists(spark, path):
        if spark.read.text(path).first()[0] != body:
            raise ValueError(f"run {name} is recorded with other settings")
    else:
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.text(path)
    return hashlib.sha256(body.encode()).hexdigest()


def require_run_record(spark: SparkSession, root: str, name: str, settings: dict, record_hash: str) -> None:
    """Stops a run whose record is missing, was changed since its hash was given, or holds other settings than it uses."""
    path = f"{root}/runs/{name}"
    if not exists(spark, path):
        raise KeyError(f"run {name} has no record; write it before the run")
    body = spark.read.text(path).first()[0]
    if hashlib.sha256(body.encode()).hexdigest() != record_hash:
        raise ValueError(f"the record of run {name} was changed")
    if body != json.dumps(settings, sort_keys=True, separators=(",", ":")):
        raise ValueError(f"run {name} uses other settings than it recorded")


def log(spark: SparkSession, root: str) -> DataFrame:
    return read_lines(spark, f"{root}/log", EVENT)


def applicable(models: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """(group, model_id, mode): the logged models that each group may be scored with, its own and the pooled ones."""
    trained = models.where("action = 'trained'").select("model_id", "mode", F.col("group").alias("_owner"))
    own = groups.select(group).join(trained.where("_owner is not null"), F.col(group) == F.col("_owner"))
    pooled = trained.where("_owner is null").agg(F.sort_array(F.collect_set(F.struct("model_id", "mode"))).alias("m")).scalar()  # a few
    return own.select(group, "model_id", "mode").unionByName(groups.select(group, F.inline(pooled)))


def infer(rows: DataFrame, root: str, model_id: str, group: str, version: str, chosen_by: str, evaluation: Column | None = None) -> DataFrame:
    """Adds ``p`` and the columns that say where it is from. ``group`` and ``version`` name the rows' group and feature
    version. Nothing is left out quietly: rows the model may not score end the job before a score is returned."""
    spark = rows.sparkSession
    model, spec = load(spark, root, model_id)
    wrong = F.coalesce(F.col(version) != spec.feature_version, F.lit(True))
    foreign = F.lit(False) if spec.group is None else F.coalesce(F.col(group) != spec.group, F.lit(True))
    shown = F.coalesce(evaluation, F.lit(False)) if evaluation is not None and spec.never_scores_evaluation else F.lit(False)
    bad = rows.agg(F.count_if(wrong).alias("version"), F.count_if(foreign).alias("group"), F.count_if(shown).alias("evaluation")).first().asDict()
    for what, n in bad.items():
        if n:
            raise NotApplicableError(f"{n} rows that model {model_id} may not score: {what}")
    if spec.never_scores_evaluation and evaluation is None:
        raise NotApplicableError("say which rows are evaluation rows")
    return model.score(rows).withColumns({"model_id": F.lit(model_id), "mode": F.lit(spec.mode), "corpus_hash": F.lit(spec.corpus_hash), "chosen_by": F.lit(chosen_by)})
