"""Two-pass beat trains, alignment, decimation, quantiles and the sequential test, on planted signals."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.functions.distributions import binomial_tail
from driftglass.operators import alignment, beats, decimation, harm, quantiles, signal

SEARCH = beats.Search(first=9.0, second=1.5, distance=8, plausible=(12, 60), half=4, chunk=1 << 20, halo=1 << 10)


def pulse(n, at, size, width=1.5):
    return size * np.exp(-0.5 * ((np.arange(n) - at) / width) ** 2)


def planted(seed, n=6_000, rr=30, inverted=()):
    """(values, strong beats, weak beats, missing beats)."""
    r = np.random.default_rng(seed)
    x, strong, weak, missing = r.normal(0, 0.25, n), [], [], []
    for k, at in enumerate(range(20, n - 20, rr)):
        at += int(r.integers(-1, 2))
        if k % 17 == 9:
            weak.append(at)
            x += pulse(n, at, 2.0)
        elif k % 23 == 14:
            missing.append(at)
            x[at - 6 : at + 7] = r.normal(0, 0.05, 13)
        else:
            strong.append(at)
            x += pulse(n, at, 6.0)
    return x, strong, weak, missing


def frame(spark, signals):
    return spark.createDataFrame([(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)], "k string, i long, v double").repartition(6)


def near(found, wanted, most=2):
    return [w for w in wanted if any(abs(f - w) <= most for f in found)]


def test_weak_beats_are_rescued_and_nothing_is_made_up(spark):
    signals = {k: planted(seed) for seed, k in enumerate("ab")}
    rows = frame(spark, {k: s[0] for k, s in signals.items()})
    got, gaps = beats.trains(rows, ["k"], "i", "v", SEARCH)
    got, gaps = got.collect(), gaps.collect()
    for k, (_, strong, weak, missing) in signals.items():
        detected = [r.at for r in got if r.k == k and r.tag == "detected"]
        rescued = [r.at for r in got if r.k == k and r.tag == "rescued"]
        assert near(detected, strong) == strong and len(detected) == len(strong)
        inner = [w for w in weak if strong[0] < w < strong[-1]]
        assert near(rescued, inner) == inner and len(rescued) == len(inner)
        assert not near(detected + rescued, missing, 5)
        empty = [m for m in missing if strong[0] < m < strong[-1]]
        assert sum(r.missing for r in gaps if r.k == k) == len(empty)
        assert all(any(r.start < m < r.stop for r in gaps if r.k == k) for m in empty)


def test_chunks_give_the_whole_record_s_train(spark):
    rows = frame(spark, {"a": planted(3)[0]})
    key = lambda df: sorted(tuple(r) for r in df.collect())
    whole = [key(df) for df in beats.trains(rows, ["k"], "i", "v", SEARCH)]
    small = beats.Search(**{**SEARCH.__dict__, "chunk": 700, "halo": 300})
    assert [key(df) for df in beats.trains(rows, ["k"], "i", "v", small)] == whole


def test_two_passes_equal_a_serial_version(spark):
    x, *_ = planted(5)
    s = SEARCH
    sigma = 1.4826 * np.median(np.abs(x - np.median(x)))
    tops = signal.tops_of(x)
    strong = signal.prominences(x, tops)
    tops, strong = tops[strong >= s.first * sigma], strong[strong >= s.first * sigma]
    stays = signal.spaced(tops, x[tops], s.distance)
    tops, strong = tops[stays], strong[stays]
    gaps = np.diff(tops)
    rr = np.median(gaps[(gaps >= s.plausible[0]) & (gaps <= s.plausible[1])])
    kept = []
    for t, p in zip(tops.tolist(), strong.tolist(), strict=True):
        if not kept or t - kept[-1][0] >= s.closest * rr:
            kept.append((t, p))
        elif p > kept[-1][1]:
            kept[-1] = (t, p)
    at = np.array([t for t, _ in kept])
    width = np.median(signal.half_widths(x, at, np.array([p for _, p in kept])))
    shape = np.mean([x[t - s.half : t + s.half + 1] for t in at if t >= s.half and t + s.half < len(x)], axis=0)
    intervals, rescued, missing = np.diff(at), [], []
    for j, gap in enumerate(intervals.tolist()):
        local = np.median(intervals[max(0, j - s.around) : j + s.around + 1])
        m = int(np.rint(gap / local))
        if m < 2 or abs(gap - m * local) > s.tolerance * local:
            continue
        found = []
        for q in range(1, m):
            centre, reach = at[j] + q * gap / m, s.window * local
            found.append(beats.best_beat(x, max(0, int(np.rint(centre - reach))), min(len(x) - 1, int(np.rint(centre + reach))), sigma, [shape], width, None, s))
        rescued += [f for f in found if f is not None]
        if None in found:
            missing.append(("a", int(at[j]), int(at[j + 1]), found.count(None)))
    train, left = beats.trains(frame(spark, {"a": x}), ["k"], "i", "v", s)
    assert sorted((r.at, r.tag) for r in train.collect()) == sorted([(int(t), "detected") for t in at] + [(t, "rescued") for t in rescued])
    assert sorted(tuple(r) for r in left.collect()) == missing


def test_several_shapes_and_a_floor(spark):
    """Beats of two shapes, some weak, and decoys of neither: only what looks like one of the shapes fills a hole."""
    r = np.random.default_rng(1)
    n, x, weak, decoys = 9_000, r.normal(0, 0.05, 9_000), [], []
    for k, at in enumerate(range(30, n - 30, 30)):
        width = (1.2 if k % 2 else 2.4) * r.uniform(0.7, 1.3)
        if k % 19 == 7:
            weak.append(at)
            x += pulse(n, at, 2.0, 1.2 if k % 2 else 2.4)
        elif k % 19 == 13:
            decoys.append(at)
            x += pulse(n, at - 2, 1.3, 0.8) - pulse(n, at + 1, 1.6, 0.8)
        else:
            x += pulse(n, at, 8.0, width)
    search = beats.Search(**{**SEARCH.__dict__, "first": 45.0, "second": 5.0, "widths": (0.2, 3.0)})
    rows = frame(spark, {"a": x})
    train, gaps = beats.trains(rows, ["k"], "i", "v", search, kind=F.col("width") > 3.6, floor=0.0)
    rescued = [q.at for q in train.where("tag = 'rescued'").collect()]
    assert near(rescued, weak) == weak and not near(rescued, decoys, 4)
    told = gaps.collect()
    assert all(any(q.start < d < q.stop for q in told) for d in decoys)
    loose = [q.at for q in beats.trains(rows, ["k"], "i", "v", search)[0].where("tag = 'rescued'").collect()]
    assert near(loose, decoys, 4)  # without a floor a decoy is taken


def test_beats_of_empty_and_flat_channels(spark):
    rows = frame(spark, {"flat": np.zeros(200), "short": np.array([1.0, 2.0])})
    train, gaps = beats.trains(rows, ["k"], "i", "v", SEARCH)
    assert train.collect() == [] and gaps.collect() == []
    none = frame(spark, {"a": np.zeros(1)}).limit(0)
    assert [df.collect() for df in beats.trains(none, ["k"], "i", "v", SEARCH)] == [[], []]


def test_fractional_shift_is_recovered(spark):
    n, true = 8_000, {}
    r = np.random.default_rng(2)
    x = r.normal(0, 0.02, n)
    marks = []
    for k, at in enumerate(range(50, n - 50, 40)):
        true[at] = [0.3, -0.4, 0.0, 1.3][k % 4]
        x += pulse(n, at + true[at], 3.0, 2.5)
        marks.append(("a", at, k % 3 != 0))
    rows, marked = frame(spark, {"a": x}), spark.createDataFrame(marks, "k string, i long, fit boolean")
    for chunk in (1 << 16, 900):
        moved, laid = alignment.aligned_regressor(rows, marked, ["k"], "i", "v", 12, 3, chunk, 64)
        lags = {m.at: m.lag for m in moved.collect()}
        off = {at: lag - true[at] for at, lag in lags.items()}
        middle = np.median(list(off.values()))  # the shape's own place is free
        assert len(lags) == len(marks) and max(abs(v - middle) for v in off.values()) < 0.08
        fit = alignment.subtracted(laid, ["k"], F.lit(True)).first()
        assert abs(fit.coefficient - 1) < 0.02 and fit.survival < 0.06 and fit.n_fit == n
    plain = sum(pulse(n, m[1], 1.0, 2.5) for m in marks)
    whole = np.linalg.norm(x - (x @ plain) / (plain @ plain) * plain) / np.linalg.norm(x)
    assert fit.survival < whole / 3  # whole samples leave far more


def test_decimation(spark):
    r = np.random.default_rng(0)
    n = 5_003
    t = np.arange(n)
    tone = np.sin(2 * np.pi * t / 400)
    alias = np.sin(2 * np.pi * t / 7.3)
    y = decimation.decimate_array(tone + alias, 6)
    assert len(y) == n // 6 and np.abs(y - tone[::6][: len(y)])[30:-30].max() < 0.01
    x = (tone + 0.1 * r.normal(size=n)).astype(float)
    x[100:103], x[900:2600], x[4990:] = np.nan, np.nan, np.nan
    for factors in ([6], [5, 4]):
        want = x
        for f in factors:
            bad = ~np.isfinite(want[: len(want) // f * f]).reshape(-1, f).all(1)
            want = decimation.decimate_array(want, f)
            assert (np.isnan(want) == bad).all()
        for chunk in (600, 1 << 18):
            rows = frame(spark, {"a": x, "b": -x}).where("not isnan(v)")
            got = {(q.k, q.i): q.v for q in decimation.decimate(rows.unionByName(spark.createDataFrame([("a", n - 1, None), ("b", n - 1, None)], "k string, i long, v double")), ["k"], "i", "v", factors, chunk).collect()}
            index = np.flatnonzero(np.isfinite(want))
            assert sorted(got) == sorted((k, int(i)) for k in "ab" for i in index)
            assert max(abs(got["a", int(i)] - want[i]) for i in index) < 1e-9
    with pytest.raises(ValueError, match="chunk"):
        decimation.decimate(rows, ["k"], "i", "v", [6], 60)


def test_exact_quantiles(spark):
    rng = random.Random(6)
    data = [("a", rng.gauss(0, 1)) for _ in range(3_001)] + [("b", float(rng.randrange(5))) for _ in range(800)] + [("c", v) for v in (1e-300, 1e300, -1e300, 0.0, -1e-300, 5.0)] + [(None, 7.0), ("e", None), ("e", float("nan")), ("f", 1.7e308), ("f", -1.7e308)]
    rows = spark.createDataFrame(data, "k string, v double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.share): r.quantile for r in quantiles.exact_quantiles(rows, ["k"], "v", shares, bins=16).collect()}
    clean = rows.where("v is not null and not isnan(v)")
    want = {(r.k, s): q for r in clean.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect() for s, q in zip(shares, r.q, strict=True)}
    assert got == want
    assert quantiles.exact_quantiles(rows.limit(0), ["k"], "v", [0.5]).collect() == []


def test_sequential_harm_equals_a_serial_version(spark):
    trial = harm.Trial(block=40, most=200, threshold=0.1, near=8, moved=1, chunk=900, halo=200)
    bump = pulse(13, 6, 1.0, 2.0)
    signals = {}
    for seed, (k, size) in enumerate({"firm": 30.0, "weak": 3.0, "edge": 8.0}.items()):
        r = np.random.default_rng(seed)
        signals[k] = r.normal(0, 0.1, 4_000) + sum(pulse(4_000, at, size) for at in range(15, 3_990, 25))
    detect = lambda x: signal.peaks(np.nan_to_num(x), 1.5, 8)
    rows = frame(spark, signals)
    got = {r.k: r for r in harm.sequential_harm(rows, ["k"], "i", "v", detect, bump, [2.0, 5.0], trial).collect()}
    channels = rows.groupBy("k").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    for k, x in signals.items():
        hits = n = rounds = 0
        done = False
        while not done and n < trial.most:
            drawn = [(r.at, r.amplitude) for r in harm.injections(channels.where(F.col("k") == k), ["k"], trial, rounds, [2.0, 5.0]).collect()]
            moved = x.copy()
            for t, a in drawn:
                for j, v in enumerate(bump):
                    if 0 <= t - 6 + j < len(x):
                        moved[t - 6 + j] += a * v
            before, after = detect(x), detect(moved)
            for t, _ in drawn:
                mine = [b for b in before if abs(b - t) <= trial.near]
                hits += any(min(abs(b - a) for a in after) > trial.moved for b in mine)
            n, rounds = n + trial.block, rounds + 1
            if hits / n <= trial.threshold:
                done = 1 - binomial_tail(hits + 1, n, trial.threshold) < 0.05  # the upper bound is below the threshold
            else:
                done = binomial_tail(hits, n, trial.threshold) < 0.05
        assert (got[k].hits, got[k].n, got[k].rounds, got[k].settled, got[k].passes) == (hits, n, rounds, done, hits / n <= trial.threshold)
    assert got["firm"].passes and not got["weak"].passes
    assert harm.settled(0, 200, 0.02, 0.95) and not harm.settled(0, 200, 0.0148, 0.95)
