"""Operators that take a function: cleaners by name, detectors re-run on suppressed spans, rounds scored by a reveal."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import overlap_join
from .matching import greedy_train_match
from .signal import finite_runs, peaks

Cleaner = Callable[[DataFrame, list[str], str, str, int], DataFrame]
Detector = Callable[[DataFrame, list[str]], DataFrame]


def none(series: DataFrame, keys: list[str], at: str, value: str, period: int) -> DataFrame:
    return series


def phase_mean(series: DataFrame, keys: list[str], at: str, value: str, period: int) -> DataFrame:
    """Less the mean of its phase."""
    rows = series.withColumn("_phase", F.col(at) % period)
    means = rows.groupBy(*keys, "_phase").agg(F.avg(value).alias("_mean"))
    return rows.join(means, [*keys, "_phase"]).withColumn(value, F.col(value) - F.col("_mean")).drop("_phase", "_mean")


def comb(series: DataFrame, keys: list[str], at: str, value: str, period: int) -> DataFrame:
    """Less the value one period before; null without one."""
    before = series.select(*keys, (F.col(at) + period).alias(at), F.col(value).alias("_before"))
    return series.join(before, [*keys, at], "left").withColumn(value, F.col(value) - F.col("_before")).drop("_before")


#: Cleaners by name; a caller's own go beside them.
CLEANERS: dict[str, Cleaner] = {"none": none, "phase_mean": phase_mean, "comb": comb}


def clean(series: DataFrame, names: list[str], keys: list[str], at: str, value: str, period: int, cleaners: dict[str, Cleaner] = CLEANERS) -> DataFrame:
    """The series once for each named cleaner; rows and times stay. An unknown name is refused."""
    unknown = sorted(set(names) - set(cleaners))
    if unknown:
        raise ValueError(f"unknown cleaners: {unknown}")
    parts = [cleaners[n](series, keys, at, value, period).select(F.lit(n).alias("cleaner"), *keys, at, value) for n in names]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def operational_damage(series: DataFrame, spans: DataFrame, keys: list[str], detector: Detector, pad: int, match: float, shift: float) -> DataFrame:
    """Whether a detector's train changes if a span is suppressed. ``series`` has (keys, at, x), ``spans`` (keys,
    start, stop), ``[start, stop)``. The detector runs on what lies within ``pad`` of each span, once as it is and
    once with the span null; outside the span the trains must be equal up to ``shift``, and a detection inside has
    nothing to be compared with and counts as changed."""
    wide = spans.select(*keys, F.col("start").alias("_start"), F.col("stop").alias("_stop"), (F.col("start") - pad).alias("r_start"), (F.col("stop") + pad).alias("r_stop"))
    points = series.withColumns({"start": F.col("at"), "stop": F.col("at") + 1})
    near = overlap_join(points, wide, keys, 4 * pad).select(*keys, F.col("_start").alias("start"), F.col("_stop").alias("stop"), "at", "x")
    event, inside = [*keys, "start", "stop"], (F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop"))
    whole = detector(near, event).select(*event, "at")
    left = detector(near.withColumn("x", F.when(~inside, F.col("x"))), event).select(*event, "at")
    train = lambda df: df.where(~inside).withColumn("t", F.col("at").cast("double")).drop("at")
    compared = greedy_train_match(train(whole), train(left), event, match)
    within = whole.where(inside).groupBy(*event).agg(F.count("*").alias("n_inside"))
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    joined = spans.select(*event).join(compared, event, "left").join(within, event, "left")
    found = joined.select(*event, count("lost"), count("added"), F.coalesce("shift", F.lit(0.0)).alias("shift"), count("n_inside"))
    return found.withColumn("changed", (F.col("lost") > 0) | (F.col("added") > 0) | (F.col("shift") > shift) | (F.col("n_inside") > 0))


def prominent(least: float, distance: int) -> Detector:
    """A detector of peaks by prominence, for ``operational_damage``: each group's rows pass sorted, one group after another;
    missing values split a group, and the highest of close peaks stays."""

    def detect(series: DataFrame, keys: list[str]) -> DataFrame:
        names = [*keys, "at"]

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held, schema, out = None, [], None, []

            def done() -> None:
                x = np.array([v for _, v in held], float)
                for lo, hi in finite_runs(x):
                    out.extend([*now, held[lo + i][0]] for i in peaks(x[lo:hi], least, distance))

            def batch_of() -> pa.RecordBatch:
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for c, n in zip(columns, names, strict=True)], names=names)

            for batch in batches:
                schema = batch.schema
                for *key, at, x in zip(*(batch[n].to_pylist() for n in [*names, "x"]), strict=True):
                    if key != now:
                        if now is not None:
                            done()
                        now, held = key, []
                    held.append((at, np.nan if x is None else x))
                yield batch_of()
                out.clear()
            if now is not None:
                done()
                yield batch_of()

        kinds = dict(series.dtypes)
        ordered = series.select(*names, "x").repartition(*keys).sortWithinPartitions(*names)
        return ordered.mapInArrow(find, ", ".join(f"{n} {kinds[n]}" for n in names))

    return detect


def damage_extent(damage: DataFrame, settle: int, lo: Column, hi: Column) -> DataFrame:
    """Spans of changed events, padded by what the consumer needs to settle, inside the record ``[lo, hi)``."""
    padded = {"extent_start": F.greatest(lo, F.col("start") - settle), "extent_stop": F.least(hi, F.col("stop") + settle)}
    return damage.where("changed").withColumns(padded)


def interval_digest(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of intervals and the sum of their hashes; whatever their order, and without gathering them."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", "start", "stop").cast("binary")), 1, 8), 16, 10).cast("long")
    digest = F.concat_ws(":", F.count("*").cast("string"), F.sum(word).cast("string"))
    return intervals.groupBy(*keys).agg(F.count("*").alias("n_candidates"), digest.alias("digest"))


def score_stored(spans: DataFrame, marks: DataFrame, shown: DataFrame, reveal: Callable[[DataFrame], DataFrame], keys: list[str], width: float, mode: str = "gate") -> DataFrame:
    """Marks of each stored span that the revealed candidates touch. ``shown`` holds the digests of the candidates that
    were shown: ``absent``, ``verified`` or ``differs``. As gate evidence a span that differs ends the job; ``tuning``
    scores it and says so."""
    if mode not in ("gate", "tuning"):
        raise ValueError(f"unknown mode: {mode}")
    found = reveal(spans)
    now = interval_digest(found, keys)
    ends = found.withColumnsRenamed({"start": "r_start", "stop": "r_stop"})
    hit = overlap_join(marks, ends, keys, width).select(*keys, "mark").distinct().groupBy(*keys).agg(F.count("*").alias("n_hit"))
    n_marks = marks.groupBy(*keys).agg(F.count("*").alias("n_marks"))
    rows = spans.join(now, keys, "left").join(shown.withColumnRenamed("digest", "_shown"), keys, "left").join(n_marks, keys, "left").join(hit, keys, "left")
    state = F.when(F.col("_shown").isNull(), "absent").when(F.col("_shown").eqNullSafe(F.col("digest")), "verified").otherwise("differs")
    if mode == "gate":
        state = F.when(state == "differs", F.raise_error(F.lit("candidates differ from those shown"))).otherwise(state)
    count = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return rows.select(*keys, state.alias("state"), count("n_candidates"), count("n_marks"), count("n_hit"), F.lit(mode).alias("mode"))
