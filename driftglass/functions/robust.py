"""Guards and robust statistics as column expressions and grouped aggregates.

NaN is "not assessable" here and becomes null at ingest: in SQL a NaN exceeds every threshold and spoils every maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values
MAD_SCALE = 1.4826
SCALE_FLOOR = 1e-6
ENVELOPE_FLOOR = 1e-12
LEAST_FRAMES = 100


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def log_envelope(x: Column) -> Column:
    return F.log(F.greatest(finite(x), F.lit(ENVELOPE_FLOOR)))


def half_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0: an undefined ratio passes no gate."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(a: Column, b: Column) -> Column:
    """Population correlation, null where a side does not vary."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def reference(df: DataFrame, keys: list[str], value: str, least: int = LEAST_FRAMES) -> DataFrame:
    """Median and scaled MAD of each group's finite values: (keys, center, scale, n), groups that are dead (scale below
    the floor) or too short left out. Two grouped aggregates and one join on the group keys."""
    rows = df.select(*keys, finite(F.col(value)).alias("_x")).where("_x is not null")
    centers = rows.groupBy(*keys).agg(median(F.col("_x")).alias("center"), F.count("*").alias("n"))
    spread = rows.join(centers, keys).groupBy(*keys).agg(F.first("center").alias("center"), F.first("n").alias("n"), (MAD_SCALE * median(F.abs(F.col("_x") - F.col("center")))).alias("scale"))
    return spread.where((F.col("scale") >= SCALE_FLOOR) & (F.col("n") >= least)).select(*keys, "center", "scale", "n")


def robust_z(df: DataFrame, reference_: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``z`` against each row's own group; groups without a reference keep a null."""
    return df.join(reference_.select(*keys, "center", "scale"), keys, "left").withColumn("z", (finite(F.col(value)) - F.col("center")) / F.col("scale")).drop("center", "scale")
