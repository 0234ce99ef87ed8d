"""Anti-aliased decimation of channels with missing samples, chunk by chunk.

Every stage filters with a linear-phase low-pass forward and backward and keeps each r-th sample; only the kept ones are
computed. For the filter alone, missing samples are bridged by straight lines between their neighbours (the nearest
value at the ends of the record), and the record goes on as its point reflection beyond its ends. A kept sample is
missing if any of the r samples it stands for is. A chunk knows the last value before its halo and the first after it, so
that long gaps are bridged as in the whole record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .signal import chunked

#: Taps on either side for each step of the factor, and the cut-off as a share of the new half rate.
REACH, CUT = 20, 0.8


def low_pass(factor: int) -> np.ndarray:
    """A windowed sinc of 20 times the factor, squared in frequency: what filtering forward and backward amounts to."""
    n = REACH * factor
    at = np.arange(n + 1) - n / 2
    once = np.sinc(CUT / factor * at) * np.hamming(n + 1)
    once /= once.sum()
    return np.convolve(once, once[::-1])


def decimate_array(x: np.ndarray, factor: int) -> np.ndarray:
    """One stage over a whole record; NaN is missing."""
    return _stage(x, 0, 0, len(x), factor, None, None)[: len(x) // factor]


def _stage(x: np.ndarray, first: int, own: int, last: int, factor: int, before: tuple[int, float] | None, after: tuple[int, float] | None) -> np.ndarray:
    """The kept samples from ``own`` on (a multiple of the factor) of a stretch that starts at ``first``; the record ends before ``last``. Only
    as many as the stretch holds whole."""
    taps, half = low_pass(factor), REACH * factor
    known = np.isfinite(x)
    if not known.any():
        return np.full((first + len(x) - own) // factor, np.nan)
    place, value = np.flatnonzero(known) + first, x[known]
    if before:
        place, value = np.concatenate(([before[0]], place)), np.concatenate(([before[1]], value))
    if after:
        place, value = np.concatenate((place, [after[0]])), np.concatenate((value, [after[1]]))
    whole = np.interp(np.arange(first, first + len(x)), place, value)
    left = half if first == 0 else 0
    right = half if first + len(x) >= last else 0
    whole = np.pad(whole, (left, right), mode="reflect", reflect_type="odd") if len(whole) > 1 else np.pad(whole, (left, right), mode="edge")
    start = own - half - (first - left)  # where the first kept sample's window starts
    if start < 0:
        raise ValueError("the halo is shorter than the filter")
    windows = np.lib.stride_tricks.sliding_window_view(whole[start:], len(taps))[::factor]
    out = windows @ taps
    gone = ~known[own - first :]
    n = min(len(out), len(gone) // factor)
    return np.where(gone[: n * factor].reshape(n, factor).any(1), np.nan, out[:n])


def decimate(samples: DataFrame, keys: list[str], at: str, value: str, factors: list[int], chunk: int = 1 << 18) -> DataFrame:
    """(keys, at, value) at the lower rate: sample j stands for the samples from j r on. ``at`` counts from 0; samples without
    a row are missing, and so are null and NaN. Missing results have no row; a last part shorter than r goes."""
    out = samples.select(*keys, F.col(at).cast("long").alias(at), F.col(value).cast("double").alias(value))
    for factor in factors:
        out = _decimated(out, keys, at, value, factor, max(1, chunk // factor) * factor)
    return out.where(F.col(value).isNotNull())


def _decimated(samples: DataFrame, keys: list[str], at: str, value: str, factor: int, chunk: int) -> DataFrame:
    halo = (REACH + 1) * factor
    if chunk < halo:
        raise ValueError("a chunk must be longer than the filter")
    kinds = dict(samples.dtypes)
    known = samples.where(F.col(value).isNotNull() & ~F.isnan(value))
    w = Window.partitionBy(*keys).orderBy("_c")
    # the last value before each chunk's halo, and the first after it
    chunks = samples.groupBy(*keys).agg(F.max(at).alias("_last")).select(*keys, (F.col("_last") + 1).alias("_size"))
    last = F.greatest(F.lit(0), F.expr(f"_size div {factor} * {factor} - 1"))
    each = samples.select(*keys, F.expr(f"{at} div {chunk}").alias("_c")).union(chunks.select(*keys, F.floor(last / chunk).cast("long"))).distinct()
    early = known.groupBy(*keys, F.floor((F.col(at) + halo) / chunk).alias("_c")).agg(F.max(F.struct(at, value)).alias("_e"))
    late = known.groupBy(*keys, F.floor((F.col(at) - halo) / chunk).alias("_c")).agg(F.min(F.struct(at, value)).alias("_l"))
    both = each.withColumn("_is", F.lit(True)).join(early, [*keys, "_c"], "full").join(late, [*keys, "_c"], "full")
    both = both.withColumn("_before", F.last("_e", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first("_l", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    ends = both.where("_is").join(chunks, keys).select(*keys, F.col("_c").alias("chunk"), "_size", F.col(f"_before.{at}").alias("ba"), F.col(f"_before.{value}").alias("bv"), F.col(f"_after.{at}").alias("aa"), F.col(f"_after.{value}").alias("av"))

    def stage(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not len(told):  # a halo of a chunk without samples of its own
            return rows.select([*keys, at, value]).slice(0, 0)
        c, size, ba, bv, aa, av = (told[n][0].as_py() for n in ("chunk", "_size", "ba", "bv", "aa", "av"))
        first, stop = max(0, c * chunk - halo), min(size, (c + 1) * chunk + halo)
        x = np.full(stop - first, np.nan)
        place = rows[at].to_numpy()
        inside = (place >= first) & (place < stop)
        x[place[inside] - first] = rows[value].to_numpy(zero_copy_only=False).astype(float)[inside]
        y = _stage(x, first, c * chunk, size, factor, None if ba is None else (ba, bv), None if aa is None else (aa, av))
        y = y[: max(0, min(chunk // factor, size // factor - c * chunk // factor))]
        # the record's last sample has a row even if it is missing, so that the next stage knows where the record ends
        index = np.flatnonzero(np.isfinite(y) | (np.arange(len(y)) + c * chunk // factor == size // factor - 1))
        out = pa.table({k: pa.chunked_array([pa.repeat(told[k][0], len(index))]) if len(index) else told[k].slice(0, 0) for k in keys})
        return out.append_column(at, pa.array(index + c * chunk // factor, pa.int64())).append_column(value, pa.array(y[index], pa.float64(), from_pandas=True))

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{at} long", f"{value} double"])
    pieces = chunked(samples, at, chunk, halo)
    return pieces.groupBy(*keys, "chunk").cogroup(ends.groupBy(*keys, "chunk")).applyInArrow(stage, schema)
