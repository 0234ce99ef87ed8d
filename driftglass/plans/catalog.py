"""All registered queries, and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftglass.operators.candidates import Settings, candidates

from . import detection, estimation, kernels, masking, matching, metrics, pluggable, records, series, trains  # noqa: F401  (they register their queries)
from .base import ORACLE_SQL, QUERIES, scored

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate intervals over daily frames."""
    z = scored(spark, sf_dir, step_s=86_400, least=10)
    found = candidates(z, Settings(enter=1.5, leave=1.0, merge_gap=2, least=1))
    return found.select(F.col("start").alias("start_frame"), F.col("stop").alias("stop_frame"), F.concat_ws("|", "signals").alias("signals"), "peak_z", "over_cap")
