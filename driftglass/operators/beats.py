"""Beat trains in two passes: peaks of the whole record first, then a second look where the train has holes.

The first pass takes peaks by prominence, in robust sigmas of their channel, and drops those too close for the
channel's median interval. An interval close to a whole multiple m of the local median holds m - 1 expected places; the
second pass looks around each of them for weaker peaks of the right width and takes the one that looks most like the
channel's mean beat. Where there is none, the interval is returned as a gap: no beat is made up.

Samples are rows ``(keys, at, value)`` with ``at`` counting samples. Kernels see chunks with a halo; medians, templates
and intervals are aggregates and windows over beats, whose number is a small share of the samples'.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.sources.shared import shared_folder, staged

from .folds import thin
from .signal import chunked, finite_runs, half_widths, prominences, spaced, tops_of


@dataclass(frozen=True)
class Search:
    """Distances are in samples."""

    first: float = 3.0  # prominence of the first pass, in robust sigmas
    second: float = 1.5  # and of the second
    distance: int = 6  # no two peaks of the first pass are closer
    plausible: tuple[float, float] = (6, 60)  # intervals that count for the median
    closest: float = 0.5  # beats closer than this share of the median interval: the weaker goes
    tolerance: float = 0.25  # how far an interval may be from a whole multiple of the local median, in local medians
    around: int = 10  # intervals on either side that make the local median
    window: float = 0.2  # how far around an expected place a beat may be, in local medians
    widths: tuple[float, float] = (0.5, 2.0)  # of a rescued beat, in median widths
    half: int = 4  # samples of a beat's shape on either side
    chunk: int = 1 << 16
    halo: int = 1 << 10


def _same(keys: list[str], other: str = "_key_") -> Column:
    found = F.lit(True)
    for k in keys:
        found &= F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return found


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_key_{k}" for k in keys})


def with_sigma(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``sigma``, 1.4826 times the median distance from the median of a key's values."""
    mid = samples.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_mid"))
    away = samples.join(_keyed(mid, keys), _same(keys)).groupBy(*keys).agg((1.4826 * F.percentile(F.abs(F.col(value) - F.col("_mid")), F.lit(0.5))).alias("sigma"))
    return samples.join(_keyed(away, keys), _same(keys)).drop(*(f"_key_{k}" for k in keys))


def _peaks(samples: DataFrame, keys: list[str], search: Search) -> DataFrame:
    """(keys, at, height, prominence, width) of the first pass."""

    def find(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        x, sigma = rows["x"].to_numpy(zero_copy_only=False).astype(float), rows["sigma"][0].as_py()
        found: list[tuple[int, float, float]] = []
        for lo, hi in finite_runs(x) if sigma else []:
            y = x[lo:hi]
            tops = tops_of(y)
            strong = prominences(y, tops)
            kept = strong >= search.first * sigma
            tops, strong = tops[kept], strong[kept]
            stays = spaced(tops, y[tops], search.distance)
            tops, strong = tops[stays], strong[stays]
            found += zip((tops + lo).tolist(), strong.tolist(), half_widths(y, tops, strong).tolist(), strict=True)
        index, strong, width = (np.array(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0), np.zeros(0))
        out = rows.take(pa.array(index.astype(np.int64))).select([*keys, "at", "x"]).rename_columns([*keys, "at", "height"])
        for name, values in (("prominence", strong), ("width", width)):
            out = out.append_column(name, pa.array(values, pa.float64()))
        return out.filter(rows["own"].take(pa.array(index.astype(np.int64))))

    kinds = dict(samples.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"at {kinds['at']}", "height double", "prominence double", "width double"])
    return chunked(samples, "at", search.chunk, search.halo).groupBy(*keys, "chunk").applyInArrow(find, schema)


def first_pass(samples: DataFrame, keys: list[str], search: Search) -> DataFrame:
    """(keys, at, height, prominence, width, rr): the plausible peaks, and their key's median interval."""
    found = _peaks(samples, keys, search)
    gap = F.col("at") - F.lag("at").over(Window.partitionBy(*keys).orderBy("at"))
    plain = found.withColumn("_gap", gap)
    rr = plain.groupBy(*keys).agg(F.percentile(F.when(F.col("_gap").between(*search.plausible), F.col("_gap")), F.lit(0.5)).alias("rr"))
    told = found.join(_keyed(rr, keys), _same(keys)).drop(*(f"_key_{k}" for k in keys)).withColumn("least", F.coalesce(search.closest * F.col("rr"), F.lit(0.0)))
    kept = thin(told, keys, "at", "least", "prominence", block=max(search.chunk, search.closest * search.plausible[1])).select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("at").alias("_at"))
    return told.join(kept, _same(keys) & (F.col("at") == F.col("_at"))).select(*keys, "at", "height", "prominence", "width", "rr")


def shapes(samples: DataFrame, beats: DataFrame, keys: list[str], search: Search, kind: Column | None = None, floor: float | None = None) -> DataFrame:
    """(keys, shapes, floor, beat_width, sigma, last): the mean of the windows around beats that lie whole in the record -
    one shape, or one for each ``kind`` of beat, a column with a few values -, the median width of the beats, and the
    record's last sample. With ``floor``, the share of the beats themselves that score below the floor; else it is null.
    Chunks give sums of their own beats' windows."""
    half = search.half
    marked = beats.select(*keys, "at", "width", (kind if kind is not None else F.lit(0)).cast("string").alias("kind"), F.expr(f"at div {search.chunk}").alias("chunk"))
    pieces = chunked(samples.select(*keys, "at", "x"), "at", search.chunk, search.halo)
    kinds = ", ".join(f"{k} {dict(samples.dtypes)[k]}" for k in keys)

    def windows(rows: pa.Table, near: pa.Table) -> dict[int, np.ndarray]:
        rows = rows.sort_by("at")
        x, at = rows["x"].to_numpy(zero_copy_only=False).astype(float), rows["at"].to_numpy()
        place = np.searchsorted(at, near["at"].to_numpy()) if len(near) else np.zeros(0, int)
        found = {i: x[p - half : p + half + 1] for i, p in enumerate(place.tolist()) if p >= half and p + half < len(x) and at[p + half] - at[p - half] == 2 * half}
        return {i: w for i, w in found.items() if np.isfinite(w).all()}

    def sums(rows: pa.Table, near: pa.Table) -> pa.Table:
        total: dict[str, list] = {}
        for i, w in windows(rows, near).items():
            entry = total.setdefault(near["kind"][i].as_py(), [np.zeros(2 * half + 1), 0])
            entry[0], entry[1] = entry[0] + w, entry[1] + 1
        out = pa.table({k: pa.repeat((rows if len(rows) else near)[k][0], len(total)) for k in keys})
        columns = {"kind": pa.array(list(total), pa.string()), "total": pa.array([t.tolist() for t, _ in total.values()], pa.list_(pa.float64())), "n": pa.array([n for _, n in total.values()], pa.int64())}
        for name, column in columns.items():
            out = out.append_column(name, column)
        return out

    parts = pieces.groupBy(*keys, "chunk").cogroup(marked.groupBy(*keys, "chunk")).applyInArrow(sums, f"{kinds}, kind string, total array<double>, n long")
    mean = F.array(*(F.sum(F.col("total")[i]) / F.sum("n") for i in range(2 * half + 1)))
    each = parts.groupBy(*keys, "kind").agg(mean.alias("shape")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("kind", "shape"))).alias("_shapes"))
    made = each.select(*keys, F.transform("_shapes", lambda s: s["shape"]).alias("shapes"))
    width = beats.groupBy(*keys).agg(F.percentile("width", F.lit(0.5)).alias("beat_width"))
    ends = samples.groupBy(*keys).agg(F.max("sigma").alias("sigma"), F.max("at").alias("last"))
    out = made
    for other in (width, ends):
        out = out.join(_keyed(other, keys), _same(keys)).drop(*(f"_key_{k}" for k in keys))
    if floor is None:
        return out.withColumn("floor", F.lit(None).cast("double"))

    def scored(rows: pa.Table, near: pa.Table) -> pa.Table:
        found = [likeness(w, [np.array(s) for s in near["shapes"][i].as_py()]) for i, w in windows(rows, near).items()]
        out = pa.table({k: pa.repeat((rows if len(rows) else near)[k][0], len(found)) for k in keys})
        return out.append_column("score", pa.array(found, pa.float64()))

    told = marked.join(_keyed(made, keys), _same(keys)).drop(*(f"_key_{k}" for k in keys))
    scores = pieces.groupBy(*keys, "chunk").cogroup(told.groupBy(*keys, "chunk")).applyInArrow(scored, f"{kinds}, score double")
    least = scores.groupBy(*keys).agg(F.percentile("score", F.lit(floor)).alias("floor"))
    return out.join(_keyed(least, keys), _same(keys), "left").drop(*(f"_key_{k}" for k in keys))


def likeness(window: np.ndarray, shapes: list[np.ndarray]) -> float:
    """The best correlation, as a cosine, of a window with some shapes."""
    size = np.linalg.norm(window)
    each = [float(window @ s) / (size * n) if size and (n := np.linalg.norm(s)) else -np.inf for s in shapes]
    return max(each, default=-np.inf)


def holes(beats: DataFrame, keys: list[str], search: Search) -> DataFrame:
    """(keys, at, stop, m, local) of each interval within the tolerance of m >= 2 local median intervals."""
    w = Window.partitionBy(*keys).orderBy("at")
    each = beats.select(*keys, "at", F.lead("at").over(w).alias("stop")).where("stop is not null").withColumn("interval", F.col("stop") - F.col("at"))
    local = each.withColumn("local", F.percentile("interval", F.lit(0.5)).over(w.rowsBetween(-search.around, search.around)))
    m = F.rint(F.col("interval") / F.col("local"))
    return local.withColumn("m", m.cast("int")).where((F.col("m") >= 2) & (F.abs(F.col("interval") - F.col("m") * F.col("local")) <= search.tolerance * F.col("local"))).select(*keys, "at", "stop", "m", "local")


def expected_places(found: DataFrame, keys: list[str], search: Search) -> DataFrame:
    """A row for each missing beat of a hole: ``q``, and the samples ``lo`` to ``hi`` around its place."""
    each = found.withColumn("q", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    centre, reach = F.col("at") + F.col("q") * (F.col("stop") - F.col("at")) / F.col("m"), search.window * F.col("local")
    return each.withColumns({"lo": F.greatest(F.rint(centre - reach), F.lit(0)).cast("long"), "hi": F.rint(centre + reach).cast("long")})


def best_beat(x: np.ndarray, lo: int, hi: int, sigma: float, shapes: list[np.ndarray], width: float | None, floor: float | None, search: Search) -> int | None:
    """The index of the peak in ``x[lo:hi + 1]`` that looks most like one of the shapes, of those that stand out enough,
    have the right width and reach the floor; missing values split the window."""
    best = None
    for a, b in finite_runs(x[lo : hi + 1]):
        y = x[lo + a : lo + b]
        tops = tops_of(y)
        strong = prominences(y, tops)
        kept = strong >= search.second * sigma
        tops, strong = tops[kept], strong[kept]
        if width:
            wide = half_widths(y, tops, strong)
            tops = tops[(wide >= search.widths[0] * width) & (wide <= search.widths[1] * width)]
        for i in (tops + lo + a).tolist():
            around = x[i - search.half : i + search.half + 1] if i >= search.half else x[:0]
            if len(around) < 2 * search.half + 1 or not np.isfinite(around).all():
                continue
            score = likeness(around, shapes)
            if np.isfinite(score) and (floor is None or score >= floor) and (best is None or score > best[0]):
                best = (score, i)
    return best[1] if best else None


def rescue(samples: DataFrame, beats: DataFrame, keys: list[str], search: Search, looks: DataFrame | None = None) -> DataFrame:
    """(keys, at, stop, q, found): each expected place of each hole with the sample of the beat found there, or null.
    ``looks`` is what ``shapes`` gives, by default one mean shape without a floor. Windows around neighbouring places do not
    meet, so each place is looked at on its own."""
    places = expected_places(holes(beats, keys, search), keys, search)
    looks = shapes(samples, beats, keys, search) if looks is None else looks
    told = places.join(_keyed(looks, keys), _same(keys)).drop(*(f"_key_{k}" for k in keys))
    told = told.withColumn("hi", F.least("hi", "last")).withColumn("chunk", F.expr(f"lo div {search.chunk}"))
    pieces = chunked(samples.select(*keys, "at", "x"), "at", search.chunk, search.halo)

    def look(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        found: list[int | None] = []
        if len(wanted):
            rows = rows.sort_by("at")
            at = rows["at"].to_numpy()
            # by place, so that samples without a row are missing values
            x = np.full(int(at[-1] - at[0]) + 1 if len(at) else 0, np.nan)
            x[at - at[0] if len(at) else []] = rows["x"].to_numpy(zero_copy_only=False).astype(float)
            for lo, hi, sigma, told_shapes, width, floor, last in zip(*(wanted[c].to_pylist() for c in ("lo", "hi", "sigma", "shapes", "beat_width", "floor", "last")), strict=True):
                if len(at) and at[-1] < min(hi + search.half, last):
                    raise ValueError("the halo is shorter than a window of the second pass")
                first = int(at[0]) if len(at) else 0
                k = best_beat(x, max(lo - first, 0), hi - first, sigma, [np.array(s) for s in told_shapes], width, floor, search) if hi - lo >= 2 else None
                found.append(None if k is None else k + first)
        return wanted.select([*keys, "at", "stop", "q"]).append_column("found", pa.array(found, pa.int64()))

    kinds = dict(samples.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"at {kinds['at']}", f"stop {kinds['at']}", "q int", "found long"])
    return pieces.groupBy(*keys, "chunk").cogroup(told.groupBy(*keys, "chunk")).applyInArrow(look, schema)


def trains(samples: DataFrame, keys: list[str], at: str, value: str, search: Search = Search(), kind: Column | None = None, floor: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Beats ``(keys, at, tag)``, ``detected`` or ``rescued``, and gaps ``(keys, start, stop, missing)``: intervals in
    which expected beats were not found. With ``kind`` and ``floor`` a rescued beat must look like one of several shapes
    as much as all but that share of the detected beats do."""
    root = shared_folder(samples.sparkSession, "beats")
    rows = staged(with_sigma(samples.select(*keys, F.col(at).cast("long").alias("at"), F.col(value).cast("double").alias("x")), keys, "x"), root, "samples")
    beats = staged(first_pass(rows, keys, search), root, "first")
    looked = staged(rescue(rows, beats, keys, search, shapes(rows, beats, keys, search, kind, floor)), root, "looked")
    both = beats.select(*keys, "at", F.lit("detected").alias("tag")).unionByName(looked.where("found is not null").select(*keys, F.col("found").alias("at"), F.lit("rescued").alias("tag")))
    gaps = looked.where("found is null").groupBy(*keys, F.col("at").alias("start"), "stop").agg(F.count("*").alias("missing"))
    return both.groupBy(*keys, "at").agg(F.min("tag").alias("tag")), gaps
