"""Kernels and distributions against closed forms."""

from __future__ import annotations

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.functions import distributions as D
from driftglass.operators import signal as K


def test_butterworth_response():
    for low, high in ((None, 10.0), (10.0, None), (8.0, 20.0)):
        sos = K.butterworth(4, low, high, 200.0)
        for f in (1.0, 8.0, 10.0, 12.0, 20.0, 60.0):
            z = np.exp(2j * np.pi * f / 200)
            gain = abs(np.prod([np.polyval(s[:3], z) / np.polyval(s[3:], z) for s in sos]))
            w = lambda x: np.tan(np.pi * x / 200)
            if low and high:
                mid, width = np.sqrt(w(low) * w(high)), w(high) - w(low)
                ratio = (w(f) ** 2 - mid**2) / (width * w(f))
            else:
                ratio = w(low) / w(f) if low else w(f) / w(high)
            assert gain == pytest.approx(1 / np.sqrt(1 + ratio**8), rel=1e-6)


def test_zero_phase_keeps_gaps_and_timing():
    t = np.arange(2000) / 200
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 60 * t)
    x[900:910] = np.nan
    y = K.zero_phase(K.butterworth(4, None, 20.0, 200.0))(x)
    assert np.isnan(y[900:910]).all() and np.isfinite(np.delete(y, range(900, 910))).all()
    assert np.abs(y - np.sin(2 * np.pi * 5 * t))[200:800].max() < 0.02
    assert 0 < K.settling(K.butterworth(4, None, 20.0, 200.0), 200.0) < 0.5


def test_chunks_agree_with_the_whole(spark):
    x = np.cumsum(np.random.default_rng(0).normal(size=600))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i long, x double")
    smooth = lambda v: np.convolve(v, np.ones(5) / 5, "same")
    got = np.array([r.y for r in K.per_chunk(df, ["k"], "i", "x", smooth, chunk=64, halo=8).orderBy("i").collect()])
    assert len(got) == 600 and np.allclose(got[4:-4], smooth(x)[4:-4])


def test_peaks_and_rate():
    t = np.arange(3000) / 100
    x = np.sin(2 * np.pi * 1.25 * t)
    found = K.peaks(x, 1.0, 10)
    assert np.allclose(np.diff(found), 80, atol=1) and len(found) == 37 or len(found) == 38
    rate, height = K.autocorr_rate(x, 100.0, 0.5, 4.0)
    assert rate == pytest.approx(1.25, rel=0.01) and height > 0.9
    assert K.spectrum_features(x, 100.0, 1.25)["line"] > 0.9


def test_exact_bounds():
    lo, hi = D.clopper_pearson(8, 10)
    assert (round(lo, 4), round(hi, 4)) == (0.4439, 0.9748)
    assert D.clopper_pearson(0, 10)[0] == 0 and D.clopper_pearson(10, 10)[1] == 1
    assert D.one_sided_lower(30, 30) == pytest.approx(0.05 ** (1 / 30), abs=1e-9) and D.needed(0.9) == 29
    assert D.binomial_tail(3, 5, 0.3) == pytest.approx(sum(comb(5, i) * 0.3**i * 0.7 ** (5 - i) for i in (3, 4, 5)))
    assert D.poisson_tail(2, 1.0) == pytest.approx(1 - 2 / np.e)


def test_poisson_binomial(spark):
    row = spark.range(1).select(D.poisson_binomial(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("d")).first()
    assert row.d == pytest.approx([0.045, 0.455, 0.455, 0.045])


def test_detectors():
    from driftglass.operators import detectors

    rng = np.random.default_rng(3)
    x = rng.normal(size=1000) * 0.1
    at = np.arange(50, 950, 90)
    for i in at:
        x[i - 3 : i + 4] += np.hanning(7) * 3
    x[500:505] = np.nan
    assert set(at.tolist()) - set(detectors.spikes(x, 10.0, 10).tolist()) <= {500}
    found = detectors.template_train(x, at[:4], 5, 0.8, 20)
    assert set(at.tolist()) - {500} <= set(found.tolist()) and len(found) <= len(at)
    clean = np.sin(np.arange(400) / 5)
    kept, lost, added = detectors.harm(clean, np.zeros(5), np.array([10, 50]), 0.5, 5, 1)
    assert kept > 10 and (lost, added) == (0, 0)
    assert detectors.harm(clean, np.hanning(9) * 9, np.arange(0, 390, 40), 0.5, 5, 1)[2] > 0


def test_lock_tests_give_the_binomial_tail(spark):
    from driftglass.operators import detectors

    rows = [("locked", 0, t) for t in (0, 24, 48, 71, 96, 119)] + [("free", 0, t) for t in (0, 11, 30, 44, 55, 91)] + [("few", 0, t) for t in (0, 24)] + [("near", 0, t) for t in (0, 1, 2, 3)]
    events = spark.createDataFrame(rows, "k string, part long, t long")
    got = {r.k: r for r in detectors.lock_tests(events, ["k"], "part", "t", 24.0, 2.0, 3).collect()}
    tail = lambda k, n, p: sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))
    for name, n, k in (("locked", 5, 5), ("free", 5, 0), ("near", 3, 0)):
        assert (got[name].m_intervals, got[name].k_locked, got[name].status) == (n, k, "tested")
        assert got[name].p == pytest.approx(tail(k, n, 4 / 24))
    assert (got["few"].status, got["few"].p) == ("untested_few_spikes", None)
