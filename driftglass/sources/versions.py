"""Versioned tables on Parquet: a version is a folder named by the hash of what it was made from."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def version_of(settings: dict) -> str:
    """SHA-256 of settings as canonical JSON: sorted keys, no blanks, nulls absent."""
    kept = {k: v for k, v in settings.items() if v is not None}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def table_hash(rows: DataFrame) -> str:
    """A hash of the rows whatever their order: sums of row hashes, so nothing is sorted or gathered."""
    each = F.xxhash64(*sorted(rows.columns))
    r = rows.select(each.alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.expr("bit_xor(h)").alias("x")).first()
    return hashlib.sha256(f"{r.n}:{r.s}:{r.x}".encode()).hexdigest()


def write_version(rows: DataFrame, root: str, settings: dict) -> str:
    """Writes a version once; a version that is there already is left as it is."""
    version = version_of(settings)
    rows.write.mode("ignore").parquet(f"{root}/version={version}")
    return version


def cached(rows: DataFrame, root: str, settings: dict, build, rebuild: bool = True) -> tuple[DataFrame, str]:
    """What ``build`` makes of the rows, and whether it was ``fresh`` or ``built``. The key is made of the settings and a hash
    of the rows' contents, so a result is read only for exactly these rows and settings; without ``rebuild`` a missing or
    stale one is an error."""
    from .shared import exists

    key = {**settings, "rows": table_hash(rows)}
    path = f"{root}/version={version_of(key)}"
    if exists(rows.sparkSession, f"{path}/_SUCCESS"):
        return rows.sparkSession.read.parquet(path), "fresh"
    if not rebuild:
        raise KeyError("no result of these rows and settings is stored")
    build(rows).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path), "built"


def read_version(spark: SparkSession, root: str, settings: dict) -> DataFrame:
    """The version made with exactly these settings; a stale one is never read instead."""
    return spark.read.parquet(f"{root}/version={version_of(settings)}")
