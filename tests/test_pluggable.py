"""Pluggable operators and guards."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftglass.operators import guards as G
from driftglass.operators import pluggable as L
from driftglass.plans.pluggable import local_maxima


def test_cleaners_keep_rows_and_refuse_unknown_names(spark):
    rows = spark.createDataFrame([("a", i, float(i % 4) + (8.0 if i == 5 else 0.0)) for i in range(12)], "k string, at long, x double")
    got = L.clean(rows, ["none", "phase_mean", "comb"], ["k"], "at", "x", 4)
    assert got.groupBy("cleaner").count().where("count = 12").count() == 3
    by = {(r.cleaner, r["at"]): r.x for r in got.collect()}
    assert by["none", 5] == 9 and by["comb", 5] == 8 and by["comb", 9] == -8 and by["comb", 1] is None
    assert by["phase_mean", 2] == 0 and by["phase_mean", 5] == pytest.approx(9 - 11 / 3)
    doubled = L.clean(rows, ["mine"], ["k"], "at", "x", 4, {"mine": lambda s, *_: s.withColumn("x", F.col("x") * 2)})
    assert doubled.agg(F.sum("x")).first()[0] == 52
    with pytest.raises(ValueError, match="unknown cleaners"):
        L.clean(rows, ["other"], ["k"], "at", "x", 4)


def test_damage_counts_what_suppression_changes(spark):
    x = [0, 3, 0, 0, 5, 0, 1, 2, 4, 0, 0, 0]
    rows = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, at long, x double")
    spans = spark.createDataFrame([("a", 4, 5), ("a", 10, 11), ("a", 8, 9), ("a", 2, 3), ("b", 0, 1)], "k string, start long, stop long")
    damage = L.operational_damage(rows, spans, ["k"], local_maxima, 4, 0.5, 0.0)
    got = {(r.k, r.start): (r.lost, r.added, r.n_inside, r.changed) for r in damage.collect()}
    assert got["a", 4] == (0, 0, 1, True)
    assert got["a", 8] == (0, 1, 1, True)
    assert got["a", 10] == (0, 1, 0, True)  # the last frame has lost its neighbour
    assert got["a", 2] == (0, 0, 0, False)
    assert got["b", 0] == (0, 0, 0, False)
    extents = L.damage_extent(damage, 3, F.lit(2), F.lit(11)).select("start", "extent_start", "extent_stop").collect()
    assert sorted(map(tuple, extents)) == [(4, 2, 8), (8, 5, 11), (10, 7, 11)]


def test_gate_evidence_that_differs_is_refused(spark):
    spans = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    marks = spark.createDataFrame([(1, 7, 5, 6), (1, 8, 50, 51), (2, 9, 5, 6)], "k long, mark long, start long, stop long")
    now = spark.createDataFrame([(1, 0, 10), (1, 4, 12), (2, 0, 3)], "k long, start long, stop long")
    reveal = lambda s: now
    same = L.interval_digest(now.where("k = 1").orderBy(F.desc("start")), ["k"]).select("k", "digest")
    got = {r.k: tuple(r)[1:5] for r in L.score_stored(spans, marks, same, reveal, ["k"], 20).collect()}
    assert got == {1: ("verified", 2, 2, 1), 2: ("absent", 1, 1, 0), 3: ("absent", 0, 0, 0)}
    other = same.withColumn("digest", F.lit("2:0"))
    assert {r.state for r in L.score_stored(spans, marks, other, reveal, ["k"], 20, "tuning").collect()} == {"differs", "absent"}
    with pytest.raises(Exception, match="candidates differ"):
        L.score_stored(spans, marks, other, reveal, ["k"], 20).collect()
    with pytest.raises(ValueError, match="unknown mode"):
        L.score_stored(spans, marks, same, reveal, ["k"], 20, "other")


def test_guards(spark):
    paths = spark.createDataFrame([("/pilot",), ("/pilot/a/",), ("/pilots/a",), ("/pilot/../a",), (None,)], "p string")
    assert [r[0] for r in paths.select(G.under(F.col("p"), "/pilot/")).collect()] == [True, True, False, False, None]
    t, f = F.lit(True), F.lit(False)
    uses = [G.table_use(t, t, f, f, F.col("p"), "/pilot"), G.table_use(t, t, f, f, F.col("p"), None), G.table_use(t, f, f, f, F.col("p"), "/pilot"), G.table_use(f, f, t, f, F.col("p"), None), G.table_use(f, f, t, t, F.col("p"), "/pilot")]
    got = paths.where("p = '/pilot/a/'").select(*uses).first()
    assert list(got) == ["stand_in", "refused: outside the pilot folder", "refused: not the stand-in", "production", "refused: not the gate's output"]
    assert paths.where("p is null").select(uses[0]).first()[0] == "refused: outside the pilot folder"
    values = spark.createDataFrame([("a", 1.0), ("a", 0.5), ("a", 3.0), ("a", None), ("a", float("nan")), ("b", 1.0), (None, 1.0)], "n string, v double")
    assert [r[0] for r in values.select(G.declared(F.col("n"), F.col("v"), {"a": (1, 2)})).collect()] == ["ok", "below", "above", "missing", "missing", "undeclared", "undeclared"]
    texts = spark.createDataFrame([('{"k": 3}',), ('{"k": "x"}',), ("{}",), ("{",), (None,)], "j string")
    assert [tuple(r) for r in texts.select(*G.optional(F.col("j"), "k", "int")).collect()] == [(3, "read"), (None, "malformed"), (None, "absent"), (None, "malformed"), (None, "absent")]
    table = {("a", "x"): "why"}
    pairs = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x")], "h string, c string")
    assert [r[0] for r in pairs.select(G.lookup([F.col("h"), F.col("c")], table)).collect()] == ["why", None, None]


def test_damage_by_prominent_peaks_equals_a_serial_version(spark):
    import numpy as np

    from driftglass.operators import pluggable as L
    from driftglass.operators.matching import match_trains
    from driftglass.operators.signal import finite_runs, peaks

    r = np.random.default_rng(5)
    series = {k: r.normal(size=160) for k in "ab"}
    series["b"][40:44] = np.nan
    rows = spark.createDataFrame([(k, i, None if np.isnan(v) else float(v)) for k, x in series.items() for i, v in enumerate(x)], "k string, at long, x double").repartition(5)
    spans = [("a", 20, 23), ("a", 60, 61), ("a", 155, 160), ("b", 41, 43), ("b", 90, 97)]
    found = L.operational_damage(rows, spark.createDataFrame(spans, "k string, start long, stop long"), ["k"], L.prominent(0.5, 3), 12, 2.0, 1.0)
    got = {(q.k, q.start, q.stop): (q.lost, q.added, q["shift"], q.n_inside, q.changed) for q in found.collect()}

    def train(x, first):
        return np.array([first + lo + i for lo, hi in finite_runs(x) for i in peaks(x[lo:hi], 0.5, 3)], float)

    want = {}
    for k, start, stop in spans:
        lo, hi = max(0, start - 12), min(160, stop + 12)
        whole = series[k][lo:hi]
        left = whole.copy()
        left[start - lo : stop - lo] = np.nan
        a, b = train(whole, lo), train(left, lo)
        outside = lambda t: t[(t < start) | (t >= stop)]  # noqa: B023, E731
        _, lost, added, shift = match_trains(outside(a), outside(b), 2.0)
        inside = len(a) - len(outside(a))
        want[k, start, stop] = (lost, added, shift, inside, bool(lost or added or shift > 1 or inside))
    assert got == want
    assert len({v[4] for v in want.values()}) > 0
