"""A regressor of a repeating shape, aligned to fractions of a sample.

The mean shape around some beats is moved along each beat by a few samples; the place of the best match, refined by a
parabola, is the beat's lag. The shape is made again from the aligned beats and laid at every beat with its lag, which
gives a series to subtract. Chunks give sums and rows of their own beats; shapes are aggregates of the sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftglass.sources.shared import shared_folder, staged

from .signal import chunked


def per_chunk_points(samples: DataFrame, points: DataFrame, keys: list[str], kernel: Callable[[np.ndarray, np.ndarray, pa.Table, pa.Table], dict], schema: str, chunk: int, halo: int) -> DataFrame:
    """Cogroups chunks of samples ``(keys, at, x)`` with the points ``(keys, at, ...)`` that lie in them. ``kernel`` gets the chunk's
    places and values in order, its rows, and its points; it gives columns beside the keys. Points near an edge go to the neighbour
    too, with ``own`` false."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def apply(rows: pa.Table, near: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        source = rows if len(rows) else near
        out = kernel(rows["at"].to_numpy(), rows["x"].to_numpy(zero_copy_only=False).astype(float), rows, near) if len(rows) else {n: [] for n in names}
        n = len(out[names[0]])
        columns = {k: pa.repeat(source[k][0], n) if n else source[k].slice(0, 0) for k in keys}
        return pa.table({**columns, **out})

    kinds = dict(samples.dtypes)
    full = ", ".join([*(f"{k} {kinds[k]}" for k in keys), schema])
    return chunked(samples, "at", chunk, halo).groupBy(*keys, "chunk").cogroup(chunked(points, "at", chunk, halo).groupBy(*keys, "chunk")).applyInArrow(apply, full)


def shift(x: np.ndarray, delay: float) -> np.ndarray:
    """``x`` later by ``delay`` samples, any real number, by straight lines; 0 beyond its ends."""
    at = np.arange(len(x), dtype=float)
    return np.interp(at - delay, at, x, left=0.0, right=0.0)


def lag_of(window: np.ndarray, shape: np.ndarray, most: int) -> float:
    """How much later than its middle the shape lies in a window, which is ``most + 1`` samples longer on either side; at most ``most``."""
    match = np.correlate(window, shape, "valid")  # for lags from -(most + 1) to most + 1
    k = 1 + int(np.argmax(match[1:-1]))
    a, b, c = match[k - 1], match[k], match[k + 1]
    bend = a - 2 * b + c
    part = 0.5 * (a - c) / bend if bend < 0 else 0.0
    return float(k - (most + 1) + np.clip(part, -0.5, 0.5))


def _windows(at: np.ndarray, x: np.ndarray, centres: np.ndarray, reach: int) -> list[tuple[int, np.ndarray]]:
    """(which centre, its window) of those whose windows lie whole in the chunk; missing values count as 0."""
    clean, place = np.nan_to_num(x), np.searchsorted(at, centres)
    return [(i, clean[p - reach : p + reach + 1]) for i, p in enumerate(place.tolist()) if p >= reach and p + reach < len(x) and at[p] == centres[i] and at[p + reach] - at[p - reach] == 2 * reach]


def _mean_shape(samples: DataFrame, beats: DataFrame, keys: list[str], half: int, chunk: int, halo: int) -> DataFrame:
    """(keys, shape): the mean window around the beats with ``fit``, each moved back by its ``lag``."""

    def sums(at: np.ndarray, x: np.ndarray, rows: pa.Table, near: pa.Table) -> dict:
        own = near.filter(near["own"]).filter(near.filter(near["own"])["fit"]) if len(near) else near
        lags = own["lag"].to_numpy(zero_copy_only=False) if len(own) else np.zeros(0)
        parts = [shift(w, -lags[i])[1:-1] for i, w in _windows(at, x, own["at"].to_numpy(), half + 1)] if len(own) else []
        return {"total": pa.array([np.sum(parts, axis=0).tolist()] if parts else [], pa.list_(pa.float64())), "n": pa.array([len(parts)] if parts else [], pa.int64())}

    parts = per_chunk_points(samples, beats, keys, sums, "total array<double>, n long", chunk, halo)
    mean = F.array(*(F.sum(F.col("total")[i]) / F.sum("n") for i in range(2 * half + 1)))
    return parts.groupBy(*keys).agg(mean.alias("shape"))


def aligned_regressor(samples: DataFrame, beats: DataFrame, keys: list[str], at: str, value: str, half: int, most: int, chunk: int = 1 << 16, halo: int = 1 << 10) -> tuple[DataFrame, DataFrame]:
    """Beats with their ``lag`` (keys, at, fit, lag), and the regressor (keys, at, x, r) at every sample.

    ``beats`` has (keys, at, fit): only beats with ``fit`` make the shape, so that rows kept apart never do. Beats too close
    to the record's ends for a window have lag 0. A channel without a shape has a regressor of 0.
    """
    if halo < 2 * (half + most + 2):
        raise ValueError("the halo is shorter than a beat's surroundings")
    root = shared_folder(samples.sparkSession, "aligned")
    rows = samples.select(*keys, F.col(at).cast("long").alias("at"), F.col(value).cast("double").alias("x"))
    marks = staged(beats.select(*keys, F.col(at).cast("long").alias("at"), F.coalesce("fit", F.lit(False)).alias("fit")), root, "beats")
    first = _mean_shape(rows, marks.withColumn("lag", F.lit(0.0)), keys, half, chunk, halo)

    def lags(at: np.ndarray, x: np.ndarray, rows: pa.Table, near: pa.Table) -> dict:
        own = near.filter(near["own"]) if len(near) else near
        found = np.zeros(len(own))
        if len(own) and own["shape"][0].as_py():
            shape = np.array(own["shape"][0].as_py())
            for i, w in _windows(at, x, own["at"].to_numpy(), half + most + 1):
                found[i] = lag_of(w, shape, most)
        return {"at": own["at"].combine_chunks() if len(own) else pa.array([], pa.int64()), "fit": own["fit"].combine_chunks() if len(own) else pa.array([], pa.bool_()), "lag": pa.array(found, pa.float64())}

    moved = staged(per_chunk_points(rows, marks.join(first, keys, "left"), keys, lags, "at long, fit boolean, lag double", chunk, halo), root, "lags")
    second = _mean_shape(rows, moved, keys, half, chunk, halo)

    def lay(at: np.ndarray, x: np.ndarray, rows: pa.Table, near: pa.Table) -> dict:
        r = np.zeros(len(at))
        if len(near) and near["shape"][0].as_py():
            shape = np.array(near["shape"][0].as_py())
            offsets = np.arange(-half, half + 1)
            for t, lag in zip(near["at"].to_pylist(), near["lag"].to_pylist(), strict=True):
                low, high = np.searchsorted(at, t - half - most - 1), np.searchsorted(at, t + half + most + 2)
                r[low:high] += np.interp(at[low:high] - t - lag, offsets, shape, left=0.0, right=0.0)
        own = rows["own"].to_numpy(zero_copy_only=False).astype(bool)
        return {"at": pa.array(at[own], pa.int64()), "x": pa.array(x[own], pa.float64(), from_pandas=True), "r": pa.array(r[own], pa.float64())}

    laid = per_chunk_points(rows, moved.join(second, keys, "left"), keys, lay, "at long, x double, r double", chunk, halo)
    return moved, laid


def subtracted(laid: DataFrame, keys: list[str], fit) -> DataFrame:
    """(keys, coefficient, rms_before, rms_after, n_fit, survival) of the least-squares fit of x on r over the rows with ``fit``; null
    where the regressor is 0."""
    chosen = laid.where(F.coalesce(fit, F.lit(False)) & F.col("x").isNotNull())
    sums = chosen.groupBy(*keys).agg(F.sum(F.col("x") * F.col("r")).alias("xr"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.count("*").alias("n_fit"))
    told = sums.withColumn("coefficient", F.try_divide("xr", "rr"))
    left = F.greatest(F.lit(0.0), F.col("xx") - F.col("coefficient") * F.col("xr"))
    return told.select(*keys, "coefficient", F.sqrt(F.col("xx") / F.col("n_fit")).alias("rms_before"), F.sqrt(left / F.col("n_fit")).alias("rms_after"), "n_fit", F.try_divide(F.sqrt(left), F.sqrt("xx")).alias("survival"))
