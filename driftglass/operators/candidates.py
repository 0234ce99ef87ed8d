"""Candidate intervals and their cores from scored frames ``(signal, frame, z)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs as R
from .joins import overlap_join


@dataclass(frozen=True)
class Settings:
    """Thresholds in robust z, lengths in frames; ``least_signals`` is the k of k-of-n."""

    enter: float = 3.0
    leave: float = 1.5
    merge_gap: int = 10
    least: int = 2
    least_signals: int = 1
    cap: int | None = None

    def __post_init__(self):
        if self.leave > self.enter:
            raise ValueError("the exit level must not exceed the entry level")


def candidates(scored: DataFrame, settings: Settings = Settings(), signal: str = "signal", recording: list[str] = ()) -> DataFrame:
    """(recording, start, stop, signals, peak_z, over_cap): runs of the combined exit flag that hold an entry, merged
    where the gap is below ``merge_gap``, then at least ``least`` long. Signals are those with an entry inside the final
    span, and the peak is over these. Signals meet per frame in one aggregate; from there on rows are runs."""
    keys, s = list(recording), settings
    z = scored.where("z is not null")
    flags = z.groupBy(*keys, "frame").agg(F.count_if(F.col("z") > s.enter).alias("_enter"), F.count_if(F.col("z") > s.leave).alias("_leave"))
    spans = R.hysteresis(flags, keys, "frame", F.col("_enter") >= s.least_signals, F.col("_leave") >= s.least_signals)
    spans = R.merge_intervals(spans, keys, s.merge_gap, strict=True).where(F.col("stop") - F.col("start") >= s.least)
    frames = z.where(F.col("z") > s.enter).select(*keys, F.col(signal), "z", F.col("frame").alias("r_start"), (F.col("frame") + 1).alias("r_stop"))
    # inside a span a signal's maximum lies at an entry frame if it has one
    hits = overlap_join(spans, frames, keys, R.BLOCK)
    found = hits.groupBy(*keys, "start", "stop").agg(F.array_sort(F.collect_set(signal)).alias("signals"), F.max("z").alias("peak_z"))
    over = F.lit(False) if s.cap is None else F.col("stop") - F.col("start") > s.cap
    return found.withColumn("over_cap", over)


def cores(scored: DataFrame, spans: DataFrame, enter: float, signal: str = "signal", recording: list[str] = ()) -> DataFrame:
    """(recording, candidate, start, stop, n_pairs, peak_signal, peak_z): runs of frames in a candidate where any signal
    is over the entry level; the peak goes to the first signal in order that reaches it."""
    keys = list(recording)
    hot = scored.where(F.col("z") > enter).select(*keys, F.col(signal), "z", F.col("frame").alias("r_start"), (F.col("frame") + 1).alias("r_stop"))
    inside = overlap_join(spans.select(*keys, "start", "stop"), hot, keys, R.BLOCK).select(*keys, F.col("start").alias("candidate"), F.col(signal), "z", F.col("r_start").alias("frame"))
    by_frame = inside.groupBy(*keys, "candidate", "frame").agg(F.collect_list(F.struct((-F.col("z")).alias("z"), F.col(signal).alias("s"))).alias("_hits"))
    found = R.true_runs(by_frame, [*keys, "candidate"], "frame")
    back = found.join(inside, [*keys, "candidate"]).where("frame >= start and frame < stop")
    best = F.min(F.struct((-F.col("z")).alias("z"), F.col(signal).alias("s"))).alias("_best")
    grouped = back.groupBy(*keys, "candidate", "start", "stop").agg(F.count_distinct(F.col(signal)).alias("n_pairs"), best)
    return grouped.select(*keys, "candidate", "start", "stop", "n_pairs", F.col("_best.s").alias("peak_signal"), (-F.col("_best.z")).alias("peak_z"))
