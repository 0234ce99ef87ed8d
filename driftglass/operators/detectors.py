"""Event detectors over one channel's stretch, as grouped maps: spikes, template trains, and what a disturbance costs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .matching import match_trains
from .signal import chunked, finite_runs, peaks


def robust_sigma(x: np.ndarray) -> float:
    good = x[np.isfinite(x)]
    return float(1.4826 * np.median(np.abs(good - np.median(good)))) if len(good) else float("nan")


def spikes(x: np.ndarray, sigmas: float, refractory: int) -> np.ndarray:
    """Indices of extrema beyond ``sigmas`` either way, the first of any two closer than ``refractory``; each finite
    stretch on its own."""
    sigma, out = robust_sigma(x), []
    if not sigma > 0:
        return np.zeros(0, int)
    mid = np.nanmedian(x)
    for lo, hi in finite_runs(x):
        y = np.abs(x[lo:hi] - mid)
        top = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:]) & (y[1:-1] > sigmas * sigma)) + 1 + lo
        for i in top:
            if not out or i - out[-1] >= refractory:
                out.append(int(i))
    return np.array(out, int)


def lock_tests(events: DataFrame, keys: list[str], part: str, at: str, period: float, tolerance: float, least: int) -> DataFrame:
    """Per key and part: is the train locked to a line of ``period``? Counts the intervals within ``tolerance`` of a whole
    multiple of it, and gives the chance of as many by independent intervals; parts of fewer than ``least`` intervals are
    not tested. The tail is summed from its first term, each from the one before."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*keys, part).orderBy(at))
    off = F.abs(F.col("_gap") - period * F.rint(F.col("_gap") / period))
    locked = (F.rint(F.col("_gap") / period) >= 1) & (off <= tolerance)
    counts = events.withColumn("_gap", gap).groupBy(*keys, part).agg(F.count("*").alias("n_spikes"), F.count("_gap").alias("m_intervals"), F.count_if(locked).alias("k_locked"))
    p0 = min(1.0, 2 * tolerance / period)

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * (F.col("m_intervals") - j + 1) / j * (p0 / (1 - p0))
        return F.struct(term.alias("term"), (s["tail"] + F.when(j >= F.col("k_locked"), term).otherwise(0.0)).alias("tail"))

    none = F.pow(F.lit(1 - p0), F.col("m_intervals"))
    start = F.struct(none.alias("term"), F.when(F.col("k_locked") == 0, none).otherwise(0.0).alias("tail"))
    tail = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("m_intervals"), F.lit(1)).cast("int")), start, step)["tail"]
    tested = F.col("m_intervals") >= least
    return counts.withColumn("status", F.when(tested, "tested").otherwise("untested_few_spikes")).withColumn("p", F.when(tested, F.least(F.lit(1.0), tail)))


def template_of(x: np.ndarray, at: np.ndarray, half: int) -> np.ndarray | None:
    """Mean window around events, of unit norm; none where no window is whole."""
    windows = [x[i - half : i + half + 1] for i in at if i >= half and i + half < len(x)]
    windows = [w - w.mean() for w in windows if np.isfinite(w).all()]
    if not windows:
        return None
    mean = np.mean(windows, axis=0)
    norm = np.linalg.norm(mean)
    return mean / norm if norm > 0 else None


def template_train(x: np.ndarray, at: np.ndarray, half: int, floor: float, refractory: int) -> np.ndarray:
    """Where the windows correlate with the events' template at or above ``floor``; of close ones the best."""
    template = template_of(x, at, half)
    if template is None:
        return np.zeros(0, int)
    r = np.full(len(x), -1.0)
    for lo, hi in finite_runs(x):
        if hi - lo < len(template):
            continue
        w = np.lib.stride_tricks.sliding_window_view(x[lo:hi], len(template))
        w = w - w.mean(1, keepdims=True)
        norm = np.linalg.norm(w, axis=1)
        r[lo + half : hi - half] = np.where(norm > 0, w @ template / np.where(norm > 0, norm, 1), -1)
    kept: list[int] = []
    for i in sorted(np.flatnonzero(r >= floor), key=lambda i: (-r[i], i)):
        if all(abs(i - j) >= refractory for j in kept):
            kept.append(int(i))
    return np.array(sorted(kept), int)


def harm(x: np.ndarray, pattern: np.ndarray, places: np.ndarray, prominence: float, distance: int, within: int) -> tuple[int, int, int]:
    """(kept, lost, added) events when a pattern is added at ``places`` and the peaks are found again."""
    moved = x.copy()
    for i in places:
        if i + len(pattern) <= len(x):
            moved[i : i + len(pattern)] += pattern
    before, after = peaks(x, prominence, distance), peaks(moved, prominence, distance)
    matched, lost, added, _ = match_trains(before.astype(float), after.astype(float), within)
    return matched, lost, added


def per_stretch(samples: DataFrame, keys: list[str], at: str, value: str, detect, chunk: int, halo: int) -> DataFrame:
    """(keys, at, height): the indices that ``detect`` finds in each chunk, those of the chunk's own samples."""
    kinds = dict(samples.dtypes)

    def apply(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(at)
        x = rows[value].to_numpy(zero_copy_only=False).astype(float)
        index = np.asarray(detect(x), int)
        picked = rows.take(pa.array(index, pa.int64()))
        return picked.select([*keys, at]).append_column("height", pa.array(x[index], pa.float64())).filter(picked["own"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{at} {kinds[at]}", "height double"])
    return chunked(samples.select(*keys, at, value), at, chunk, halo).groupBy(*keys, "chunk").applyInArrow(apply, schema)
