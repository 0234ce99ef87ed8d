"""The corpus pipeline: each stage is written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftglass.llm import stages
from driftglass.llm.common import Stage, read_table

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", stages.quality_rules),
    ("simhash near-dedup", stages.drop_near_duplicates),
    ("suffix-array dedup", stages.drop_passages),
    ("mixing sources to target weights", stages.mix_sources),
    ("packing", stages.pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; returns what the last one gives."""
    docs, stage = read_table(spark, sf_dir, "documents"), Stage(spark, "pipeline")
    for k, (_, function) in enumerate(STAGES):
        docs = stage.save(function(spark, docs, sf_dir), f"stage-{k}")
        if k:
            stage.drop(f"stage-{k - 1}")
    return docs
