"""Folds by blocks against one serial pass."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftglass.operators import folds, ranking
from driftglass.operators.matching import greedy_train_match, match_trains


def serial(rows, least):
    """Time-ordered: the last kept row gives way to a stronger one closer than ``least``."""
    kept = []
    for t, s in sorted(rows):
        if not kept or t - kept[-1][0] >= least:
            kept.append((t, s))
        elif s > kept[-1][1]:
            kept[-1] = (t, s)
    return kept


@pytest.mark.parametrize("block", [6, 7, 20, 1000])
def test_thin_equals_the_serial_fold(spark, block):
    rng = random.Random(block)
    data = [(k, rng.randrange(0, 400), rng.choice([0.0, 1.0, rng.random()])) for k in ("a", "b", None) for _ in range(150)]
    data += [("dense", t, float(t % 7)) for t in range(200)] + [("rise", t, float(t)) for t in range(100)] + [("gap", t, 1.0) for t in (0, 500, 501, 1500)] + [("neg", t, 1.0) for t in range(-50, 5, 3)]
    rows = spark.createDataFrame([*data, ("a", None, 1.0)], "k string, t long, s double").repartition(4)
    by = {}
    for k, t, s in data:
        by.setdefault(k, []).append((t, s))
    got = sorted(((r.k, r.t, r.s) for r in folds.thin(rows, ["k"], "t", 6, "s", block).collect()), key=str)
    assert got == sorted(((k, *r) for k, v in by.items() for r in serial(v, 6)), key=str)
    first = sorted(((r.k, r.t) for r in folds.thin(rows, ["k"], "t", 6, block=block).collect()), key=str)
    assert first == sorted(((k, t) for k, v in by.items() for t, _ in serial([(t, 0) for t, _ in v], 6)), key=str)


def test_distance_of_each_key(spark):
    rows = spark.createDataFrame([(k, t, {"a": 2.0, "b": 9.0}[k]) for k in "ab" for t in range(40)], "k string, t long, d double")
    got = folds.thin(rows, ["k"], "t", "d", block=10).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {"a": 20, "b": 5}
    with pytest.raises(ValueError, match="block"):
        folds.thin(rows, ["k"], "t", "d")


def test_one_hot_key_of_a_million_rows(spark):
    """Rows 0.6 distances apart never fall into step, whatever block they start in; many tasks, one answer."""
    n = 1_000_000
    rows = spark.range(n).select(F.lit("hot").alias("k"), (F.col("id") * 3).alias("t"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("s"))
    kept = ranking.refractory(rows, ["k"], "t", 5).agg(F.count("*"), F.min("t"), F.max("t"), F.count_if(F.col("t") % 6 != 0)).first()
    assert tuple(kept) == (n // 2, 0, 3 * n - 6, 0)
    strength = [float(r.s) for r in rows.select("s").collect()]
    want = serial([(3 * i, s) for i, s in enumerate(strength)], 5)
    got = sorted((r.t, r.s) for r in ranking.suppress(rows, ["k"], "t", "s", 5).collect())
    assert got == want
    blocks = rows.select(F.floor(F.col("t") / (1024 * 5)).alias("b")).distinct().count()
    assert blocks > 500


@pytest.mark.parametrize("block", [3.0, 11.0, 10_000.0])
def test_bursts_by_blocks(spark, block):
    rng = random.Random(2)
    data = [(k, rng.randrange(0, 3000) / 4) for k in ("a", None) for _ in range(120)] + [("lone", 5.0), ("twice", 7.0), ("twice", 7.0)]
    rows = spark.createDataFrame(data, "k string, t double")
    want = []
    for k in ("a", None, "lone", "twice"):
        start = last = None
        for t in sorted(t for q, t in data if q == k):
            start = t if last is None or t - last > 4 else start
            last = t
            want.append((k, t, start))
    got = sorted(((r.k, r.t, r._burst) for r in folds.bursts(rows, ["k"], "t", lambda gap: gap > 4, block).collect()), key=str)
    assert got == sorted(want, key=str)


def test_matching_streams_bursts(spark):
    rng = random.Random(8)
    trains = {k: ([rng.randrange(0, 4000) / 2 for _ in range(300)], [rng.randrange(0, 4000) / 2 for _ in range(300)]) for k in (1, 2, None)}
    side = lambda i: spark.createDataFrame([(k, t) for k, pair in trains.items() for t in pair[i]], "k long, t double")
    for within, block in ((0.5, 2.0), (3.0, None), (50.0, 70.0)):
        got = {r.k: (r.matched, r.lost, r.added, r["shift"]) for r in greedy_train_match(side(0), side(1), ["k"], within, block).collect()}
        assert got == {k: match_trains(np.array(a), np.array(b), within) for k, (a, b) in trains.items()}


def brute_match(reference, test, within):
    test, free, shifts = sorted(test), None, []
    free = [True] * len(test)
    for t in sorted(reference):
        near = [(abs(x - t), i) for i, x in enumerate(test) if free[i] and abs(x - t) <= within]
        if near:
            free[min(near)[1]] = False
            shifts.append(min(near)[0])
    return len(shifts), len(reference) - len(shifts), sum(free), max(shifts, default=0.0)


def test_match_trains_equals_brute_force():
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.randrange(0, 60) / 2 for _ in range(rng.randrange(0, 15))] for _ in range(2))
        for within in (0.0, 1.0, 4.5):
            assert match_trains(np.array(a), np.array(b), within) == brute_match(a, b, within)
