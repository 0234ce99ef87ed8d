"""Run, interval and join primitives against plain loops."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from driftglass.operators import estimation, evaluation, joins, ranking, rules, versions
from driftglass.operators import runs as R
from driftglass.operators.candidates import Settings, candidates
from driftglass.operators.matching import greedy_train_match, match_trains


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_runs_cross_block_edges(spark):
    rng = random.Random(1)
    at = {k: sorted(rng.sample(range(300), 180)) for k in ("a", "b")}
    df = spark.createDataFrame([(k, i) for k, v in at.items() for i in v], "k string, i long")
    want = []
    for k, v in at.items():
        start = prev = v[0]
        for i in [*v[1:], None]:
            if i != prev + 1:
                want.append((k, start, prev + 1))
                start = i
            prev = i
    for block in (7, 64, 4096):
        assert rows_of(R.true_runs(df, ["k"], "i", block)) == sorted(want)


def test_hysteresis_and_merge(spark):
    z = [0.0, 1.2, 2.5, 1.1, 0.0, 1.5, 1.4, 0.0, 0.0, 2.1, None, 2.2, 1.0, 3.0]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(z)], "signal string, frame long, z double")
    found = R.hysteresis(df, ["signal"], "frame", F.col("z") > 2, F.col("z") > 1, block=3)
    assert rows_of(found.select("start", "stop")) == [(1, 4), (9, 10), (11, 12), (13, 14)]
    assert rows_of(R.merge_intervals(found, ["signal"], 1).select("start", "stop")) == [(1, 4), (9, 14)]
    assert rows_of(R.merge_intervals(found, ["signal"], 1, strict=True).select("start", "stop")) == [(1, 4), (9, 10), (11, 12), (13, 14)]
    bounds = spark.createDataFrame([("s", 0, 20), ("t", 3, 5)], "signal string, lo long, hi long")
    assert rows_of(R.complement(found, bounds, ["signal"])) == [("s", 0, 1), ("s", 4, 9), ("s", 10, 11), ("s", 12, 13), ("s", 14, 20), ("t", 3, 5)]


def test_merge_in_blocks_is_the_same(spark):
    rng = random.Random(2)
    iv = [("k", s, s + rng.choice([0.5, 3.0, 20.0])) for s in (rng.random() * 500 for _ in range(200))]
    df = spark.createDataFrame(iv, "k string, start double, stop double")
    assert rows_of(R.merge_intervals(df, ["k"], 0.3)) == rows_of(R.merge_intervals(df, ["k"], 0.3, block=16.0))


def test_candidates_order_of_steps(spark):
    z = {("a", 5): 3.5, ("a", 6): 2.0, ("b", 12): 4.0, ("a", 30): 9.0, ("b", 40): 1.6, ("b", 41): 1.7}
    df = spark.createDataFrame([(s, f, v) for (s, f), v in z.items()], "signal string, frame long, z double")
    got = candidates(df, Settings(merge_gap=10, least=2)).select("start", "stop", "signals", "peak_z").collect()
    # the single frames 5-7 and 12 meet first and then are long enough; frame 30 alone is not
    assert [tuple(r) for r in got] == [(5, 13, ["a", "b"], 4.0)]
    assert candidates(df, Settings(merge_gap=10, least=2, cap=5)).first().over_cap
    assert candidates(df, Settings(merge_gap=1, least=1, least_signals=2)).count() == 0


def test_overlap_join(spark):
    rng = random.Random(3)
    iv = lambda n: [(i % 2, i, s, s + rng.choice([1, 5, 40])) for i in range(n) for s in [rng.randrange(200)]]
    a, b = iv(60), iv(50)
    left = spark.createDataFrame(a, "k long, id long, start long, stop long")
    right = spark.createDataFrame(b, "k long, rid long, r_start long, r_stop long")
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2]))
    for width in (3, 16, 1000):
        assert rows_of(joins.overlap_join(left, right, ["k"], width).select("id", "rid")) == want
    hit = {i for i, _ in want}
    assert {r.id for r in joins.overlap_join(left, right, ["k"], 16, "left_anti").collect()} == {x[1] for x in a} - hit


def test_as_of_and_nearest(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), i, float(rng.randrange(100))) for i in range(80)]
    ev = [(rng.randrange(2), float(rng.randrange(100))) for _ in range(25)]
    left, right = spark.createDataFrame(rows, "k long, id long, t double"), spark.createDataFrame(ev, "k long, t double")
    for width in (5.0, 1000.0):
        got = {r.id: (r.before, r.after, r.distance) for r in joins.nearest(left, right, ["k"], width).collect()}
        strict = {r.id: r.e_t for r in joins.as_of(left, right, ["k"], width, strict=True).collect()}
        for k, i, t in rows:
            near = [e for q, e in ev if q == k]
            before, after = max((e for e in near if e <= t), default=None), min((e for e in near if e >= t), default=None)
            assert got[i] == (before, after, min(abs(e - t) for e in near)) and strict[i] == max((e for e in near if e < t), default=None)


def test_folds(spark):
    rows = spark.createDataFrame([("a", t, s) for t, s in [(0, 1.0), (3, 2.0), (5, 9.0), (20, 4.0), (24, 4.0), (40, 1.0)]], "k string, t long, s double")
    assert rows_of(ranking.refractory(rows, ["k"], "t", 5)) == [("a", 0), ("a", 5), ("a", 20), ("a", 40)]
    assert rows_of(ranking.suppress(rows, ["k"], "t", "s", 5)) == [("a", 5, 9.0), ("a", 20, 4.0), ("a", 40, 1.0)]
    assert match_trains(np.array([1.0, 2.0, 9.0]), np.array([1.9, 2.4, 30.0]), 1.0)[:3] == (2, 1, 1)


def test_holm_stops_at_the_first_failure(spark):
    tests = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.001, 0.006, 0.0099, 0.0001])], "g string, i long, p double")
    assert {r.i for r in ranking.holm(tests, ["g"], "p", 0.01, ["i"]).where("rejected").collect()} == {0, 3}


def test_undefined_is_not_a_pass(spark):
    rows = spark.createDataFrame([("x", 0, 0.1)], "g string, y long, p double")
    r = evaluation.confusion(rows, "y", F.col("p") > 0.5, "g").where("scope = 'x'").first()
    assert r.prec is None and r.rec is None and r.f1 is None
    assert spark.range(1).select(evaluation.status(F.lit(None).cast("boolean")).alias("s")).first().s == "not computable"


def test_rules_and_versions(spark):
    names = spark.createDataFrame([("ab_raw",), ("b",), ("zz",), (None,)], "n string")
    found = rules.classify(names, "n", [("r1", 2, "^a", "A"), ("r2", 2, "b$", "B"), ("r3", 1, "^b", "C")], ["_raw"])
    assert {r.n: (r.outcome, r.rule_id) for r in found.collect()} == {"ab_raw": ("ambiguous", "r1"), "b": ("C", "r3"), "zz": (None, None), None: (None, None)}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, None)], "k long, v string")
    assert rows_of(versions.diff(old, new, "k", ["v"])) == [(1, "removed"), (2, "changed"), (3, "added")]
    assert versions.append_new(old, new.where("k = 3"), "k").count() == 3


def test_isotonic_pools_violators(spark):
    bins = spark.createDataFrame([(0, 0.2, 1.0), (1, 0.6, 1.0), (2, 0.4, 1.0), (3, 0.3, 2.0), (4, 0.9, 1.0)], "b int, m double, w double")
    got = {r.b: round(r.fit, 6) for r in estimation.isotonic(bins, "b", "m", "w").collect()}
    assert got == {0: 0.2, 1: 0.4, 2: 0.4, 3: 0.4, 4: 0.9}


def test_trains_cut_at_gaps_match_as_wholes(spark):
    rng = random.Random(5)
    trains = {k: ([rng.randrange(0, 400) / 2 for _ in range(rng.randrange(0, 40))], [rng.randrange(0, 400) / 2 for _ in range(rng.randrange(1, 40))]) for k in "abcdef"}
    side = lambda i: spark.createDataFrame([(k, t) for k, pair in trains.items() for t in pair[i]], "k string, t double")
    for within in (0.5, 2.0, 7.0):
        got = {r.k: (r.matched, r.lost, r.added, r["shift"]) for r in greedy_train_match(side(0), side(1), ["k"], within).collect()}
        assert got == {k: match_trains(np.array(a), np.array(b), within) for k, (a, b) in trains.items()}


def test_balance_takes_the_least_used(spark):
    rng = random.Random(9)
    data = [(k, i, sorted(rng.sample("wxyz", rng.randrange(0, 4)))) for k in "ab" for i in range(300)]
    want, uses = {}, {}
    for k, i, options in data:
        pick = min(options, key=lambda o: (uses.get((k, o), 0), options.index(o))) if options else None
        uses[k, pick] = uses.get((k, pick), 0) + 1
        want[k, i] = pick
    rng.shuffle(data)
    rows = spark.createDataFrame(data, "k string, i long, allowed array<string>").repartition(5)
    assert {(r.k, r.i): r.chosen for r in ranking.balance(rows, ["k"], "i", "allowed").collect()} == want


def test_folds_cut_into_bursts_are_the_same(spark):
    rng = random.Random(3)
    data = [(k, rng.randrange(0, 300), rng.random()) for k in "abc" for _ in range(80)]
    rows = spark.createDataFrame(data, "k string, t long, s double")
    first, best = [], []
    for k in "abc":
        kept, strong = [], []
        for _, t, s in sorted(r for r in data if r[0] == k):
            if not kept or t - kept[-1] >= 6:
                kept.append(t)
            if not strong or t - strong[-1][0] >= 6:
                strong.append((t, s))
            elif s > strong[-1][1]:
                strong[-1] = (t, s)
        first += [(k, t) for t in kept]
        best += [(k, t, s) for t, s in strong]
    assert rows_of(ranking.refractory(rows, ["k"], "t", 6)) == sorted(first)
    assert rows_of(ranking.suppress(rows, ["k"], "t", "s", 6)) == sorted(best)


def test_multiset_digest_ignores_order_only(spark):
    digest = lambda values: spark.createDataFrame([(v,) for v in values], "v string").agg(versions.multiset_digest(F.sha2(F.col("v").cast("binary"), 256))).first()[0]
    assert digest(["a", "b", "b"]) == digest(["b", "a", "b"]) != digest(["a", "a", "b"])
    assert digest(["a", None]) == digest(["a"]) != digest(["a", "a"])
