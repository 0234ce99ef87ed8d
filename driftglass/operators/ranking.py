"""Selections that depend on order: refractory times, suppression, step-down tests and balancing."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.functions.robust import ratio

from .folds import thin


def refractory(rows: DataFrame, keys: list[str], at: str, least: float) -> DataFrame:
    """Keeps the first row and each later one at least ``least`` after the last kept."""
    return thin(rows, keys, at, least)


def suppress(rows: DataFrame, keys: list[str], at: str, strength: str, least: float) -> DataFrame:
    """Non-maximum suppression in order of ``at``: a row closer than ``least`` to the last kept one replaces it if it is
    stronger, and goes otherwise."""
    return thin(rows, keys, at, least, strength)


def holm(tests: DataFrame, family: list[str], p: str, alpha: float, ties: list[str]) -> DataFrame:
    """Adds ``rejected``: step-down at alpha / (m - rank), stopping at the first failure of a family. No bar is above
    alpha, so only the tests at or below it are ranked; the others are counted and pass by."""
    counts = tests.groupBy(*family).agg(F.count("*").alias("_m"))
    small = tests.where(F.col(p) <= alpha)
    ranked = small.join(counts, family) if family else small.withColumn("_m", counts.scalar())
    w = Window.partitionBy(*family).orderBy(p, *ties).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_i", F.row_number().over(Window.partitionBy(*family).orderBy(p, *ties)))
    passed = F.bool_and(F.col(p) <= alpha / (F.col("_m") - F.col("_i") + 1)).over(w)
    judged = ranked.withColumn("rejected", F.coalesce(passed, F.lit(False))).drop("_i", "_m")
    rest = tests.where(F.coalesce(F.col(p) > alpha, F.lit(True))).withColumn("rejected", F.lit(False))
    return judged.select(*tests.columns, "rejected").unionByName(rest)


def best_threshold(rows: DataFrame, steps: int) -> DataFrame:
    """(threshold, f1) of the best cut ``p >= i / steps`` for columns y and p. One aggregate over the rows, then sums
    over ``steps + 1`` cells."""
    cell = F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(F.col("p") * steps))).cast("int")
    # a cell's lower bound, compared as the threshold itself is
    cell = F.when(F.col("p") >= (cell + 1) / steps, cell + 1).when(F.col("p") < cell / steps, cell - 1).otherwise(cell)
    cells = rows.groupBy(cell.alias("i")).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    grid = rows.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i")).join(cells, "i", "left").fillna(0)
    up = Window.orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("pos").over(Window.partitionBy())
    counts = grid.select("i", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"), total.alias("all"))
    f1 = ratio(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all"))
    best = counts.select("i", f1.alias("f1")).agg(F.min(F.struct((-F.coalesce(F.round("f1", 9), F.lit(-1.0))).alias("k"), "i", "f1")).alias("m"))
    return best.select((F.col("m.i") / steps).alias("threshold"), F.col("m.f1").alias("f1"))


def balance(rows: DataFrame, keys: list[str], at: str, allowed: str) -> DataFrame:
    """Adds ``chosen``: in order of ``at`` each row takes the allowed value that its key has used least so far, the first
    of equals; null where nothing is allowed. Each choice depends on all before it, so a key is one pass over sorted
    rows; the pass holds a counter per value, and no rows."""
    names = [*keys, at, allowed]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, uses = None, Counter()
        for batch in batches:
            chosen = []
            for *key, options in zip(*(batch[k].to_pylist() for k in keys), batch[allowed].to_pylist(), strict=True):
                if key != last:
                    last, uses = key, Counter()
                chosen.append(min(options, key=uses.__getitem__) if options else None)
                uses[chosen[-1]] += 1
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names[:-1]), pa.array(chosen, pa.string())], [*names[:-1], "chosen"])

    kinds = dict(rows.dtypes)
    ordered = rows.select(*names).repartition(*keys).sortWithinPartitions(*names)
    return ordered.mapInArrow(choose, ", ".join([*(f"{n} {kinds[n]}" for n in names[:-1]), "chosen string"]))
