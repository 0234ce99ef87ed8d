"""Continued trees, chosen weights, nested search, the registry, stored rules, caches and the stateful stream."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from driftglass.operators import boosting, registry, rules
from driftglass.operators.runs import hysteresis
from driftglass.sources import versions
from driftglass.streaming.replay import log_stream, to_table
from driftglass.streaming.runs import hysteresis_stream

SMALL = boosting.Settings(trees=3, depth=2)


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    data = []
    for i in range(360):
        a, b = r.random(), r.random()
        data.append((i, a, b, float((a + 0.4 * b > 0.7) != (r.random() < 0.12)), f"g{i % 3}", f"s{i % 9}"))
    return spark.createDataFrame(data, "id long, a double, b double, y double, g string, s string").coalesce(1).cache()


def test_continued_trees_equal_one_longer_fit(spark, rows):
    whole = boosting.fit(rows, ["a", "b"], settings=boosting.Settings(trees=5, depth=2))
    first = boosting.fit(rows, ["a", "b"], settings=boosting.Settings(trees=2, depth=2))
    more = boosting.fit(rows, ["a", "b"], settings=boosting.Settings(trees=3, depth=2), start=first)
    assert more.content_id() == whole.content_id() != first.content_id()
    assert len(first.trees) == 2  # what is continued stays as it was
    scores = lambda m: {r.id: r.p for r in m.score(rows).select("id", "p").collect()}
    assert scores(more) == scores(whole) != scores(first)
    right = sum((p > 0.5) == (r.y == 1) for r in rows.collect() for p in [scores(whole)[r.id]])
    assert right > 290
    margins = {r.id: r.m for r in first.margin(rows, "m").select("id", "m").collect()}
    by_hand = rows.collect()
    from pyspark.ml.linalg import Vectors

    for r in by_hand[:20]:
        want = first.base + sum(rate * t.predict(Vectors.dense([r.a, r.b])) for t, rate in zip(first.trees, first.rates, strict=True))
        assert margins[r.id] == pytest.approx(want, abs=1e-12)


def test_fits_refuse_and_skip(spark, rows):
    with pytest.raises(ValueError, match="single class"):
        boosting.fit(rows.where("y = 1"), ["a"], settings=SMALL)
    model = boosting.fit(rows, ["a", "b"], settings=SMALL)
    with pytest.raises(ValueError, match="features"):
        boosting.fit(rows, ["a"], settings=SMALL, start=model)
    holes = spark.createDataFrame([(1, None, 0.5), (2, float("nan"), 0.5), (3, 0.1, 0.1)], "id long, a double, b double")
    assert {r.id: r.p is None for r in model.score(holes).collect()} == {1: True, 2: True, 3: False}


def test_weight_is_chosen_on_inner_folds(spark, rows):
    """The same by hand: each fold held out, F1 over all held-out rows together, the smallest of equals."""
    grid, own, some = [1.0, 6.0], F.col("g") == "g0", rows.where("s in ('s0', 's3', 's1', 's2')")
    found, chosen, pooled = boosting.choose_weight(some, own, "s", grid, ["a", "b"], settings=SMALL, adapt=boosting.Settings(trees=2, depth=2))
    assert {(r.fold, r.w) for r in found.collect()} == {(s, w) for s in ("s0", "s3") for w in grid}
    f1 = {}
    for w in grid:
        tp = fp = fn = 0
        for fold in ("s0", "s3"):
            rest = some.where(F.col("s") != fold)
            train = boosting.balanced(rest, "y", 0.5).withColumn("weight", F.col("weight") * F.when(own, w).otherwise(1.0))
            model = boosting.fit(train, ["a", "b"], "y", "weight", boosting.Settings(trees=2, depth=2), start=pooled)
            for r in model.score(some.where(F.col("s") == fold)).collect():
                tp, fp, fn = tp + (r.p >= 0.5 and r.y == 1), fp + (r.p >= 0.5 and r.y == 0), fn + (r.p < 0.5 and r.y == 1)
        f1[w] = 2 * tp / (2 * tp + fp + fn)
    assert {r.w: r.f1 for r in boosting.pooled_f1(found, ["w"], "y", "p").collect()} == pytest.approx(f1)
    assert chosen == min(w for w in grid if f1[w] == max(f1.values()))
    assert boosting.chosen_weight([4.0, 1.0, 2.0], {4.0: 0.5, 1.0: None, 2.0: 0.5}) == 2.0
    assert boosting.chosen_weight([4.0, 1.0], {}) == 1.0


def test_nested_search_keeps_groups_apart(spark, rows, monkeypatch):
    some, seen = rows.where("s in ('s0', 's1', 's3', 's4')"), []
    inner = boosting.inner_f1

    def spied(train, *rest):
        seen.append({(r.g, r.s) for r in train.select("g", "s").distinct().collect()})
        return inner(train, *rest)

    monkeypatch.setattr(boosting, "inner_f1", spied)
    search = lambda seed: [boosting.Settings(trees=1, depth=1, seed=seed), boosting.Settings(trees=3, depth=2, seed=seed)]
    scored, trials = boosting.nested(some, "g", "s", ["a", "b"], search)
    told = trials.collect()
    assert [(r.fold, r.trial) for r in told] == [("g0", 0), ("g0", 1), ("g1", 0), ("g1", 1)]
    assert [{g for g, _ in s} for s in seen] == [{"g1"}, {"g1"}, {"g0"}, {"g0"}]  # the group held out is never passed
    assert sorted(r.id for r in scored.collect()) == sorted(r.id for r in some.collect())
    assert {r.fold for r in scored.where("g = 'g1'").collect()} == {"g1"}
    for fold in ("g0", "g1"):
        mine = [r for r in told if r.fold == fold]
        best = max(r.f1 for r in mine)
        assert [r.chosen for r in mine].index(True) == next(k for k, r in enumerate(mine) if r.f1 == best)
        settings = boosting.Settings(**json.loads(next(r.settings for r in mine if r.chosen)))
        model = boosting.fit(boosting.balanced(some.where(F.col("g") != fold), "y", 0.5), ["a", "b"], "y", "weight", settings)
        want = {r.id: r.p for r in model.score(some.where(F.col("g") == fold)).collect()}
        assert {r.id: r.p for r in scored.where(F.col("fold") == fold).collect()} == want
    assert list(boosting.random_search(3)(1)) == list(boosting.random_search(3)(1)) != list(boosting.random_search(3)(2))
    with pytest.raises(ValueError, match="over 2 groups"):
        boosting.groups_of(rows, "g", 2)


def test_registered_models_score_in_another_session(spark, rows, tmp_path):
    root = str(tmp_path)
    model = boosting.fit(rows, ["a", "b"], settings=SMALL)
    spec = registry.Spec(model.content_id(), registry.POOLED, None, "v2", "c" * 8)
    told = {"spec": spec.__dict__}
    assert registry.register(spark, root, model, spec, "me", told) == model.content_id()
    registry.register(spark, root, model, spec, "me", told)  # the same again changes nothing
    new = rows.withColumn("version", F.lit("v2"))
    other = spark.newSession()
    table = other.createDataFrame([tuple(r) for r in new.collect()], new.schema)
    got = {r.id: (r.p, r.model_id, r.mode, r.corpus_hash, r.chosen_by) for r in registry.infer(table, root, spec.model_id, "g", "version", "someone").collect()}
    assert got == {r.id: (r.p, spec.model_id, "pooled", "c" * 8, "someone") for r in model.score(rows).collect()}
    assert registry.log(spark, root).count() == 1

    with pytest.raises(registry.NotApplicableError, match="version"):
        registry.infer(new.withColumn("version", F.lit("v1")), root, spec.model_id, "g", "version", "x")
    with pytest.raises(registry.NotApplicableError, match="version"):
        registry.infer(new.withColumn("version", F.lit(None).cast("string")), root, spec.model_id, "g", "version", "x")
    with pytest.raises(KeyError):
        registry.infer(new, root, "0" * 64, "g", "version", "x")
    with pytest.raises(ValueError, match="another spec"):
        changed = registry.Spec(**{**spec.__dict__, "feature_version": "v3"})
        registry.register(spark, root, model, changed, "me", {"spec": changed.__dict__})
    with pytest.raises(ValueError, match="content id"):
        registry.register(spark, root, model, registry.Spec("1" * 64, "pooled", None, "v2", "c"), "me", {})
    with pytest.raises(ValueError, match="carry this spec"):
        registry.register(spark, root, model, spec, "me", {})


def test_adapted_models_stay_with_their_group(spark, rows, tmp_path):
    root = str(tmp_path)
    model = boosting.fit(rows.where("g = 'g1'"), ["a", "b"], settings=SMALL)
    spec = registry.Spec(model.content_id(), registry.ADAPTED, "g1", "v2", "c", never_scores_evaluation=True)
    with pytest.raises(ValueError, match="separation"):
        registry.register(spark, root, model, spec, "me", {"spec": spec.__dict__})
    registry.register(spark, root, model, spec, "me", {"spec": spec.__dict__, "evaluation_rows_checked": True})
    new = rows.withColumn("version", F.lit("v2"))
    own = new.where("g = 'g1'")
    apply = lambda df, **more: registry.infer(df, root, spec.model_id, "g", "version", "x", **more)
    assert apply(own, evaluation=F.lit(False)).count() == 120
    with pytest.raises(registry.NotApplicableError, match="group"):
        apply(new, evaluation=F.lit(False))
    with pytest.raises(registry.NotApplicableError, match="evaluation"):
        apply(own, evaluation=F.col("id") == 1)
    with pytest.raises(registry.NotApplicableError, match="say which"):
        apply(own)
    groups = rows.select("g").distinct()
    assert [tuple(r) for r in registry.applicable(registry.log(spark, root), groups, "g").collect()] == [("g1", spec.model_id, "adapted")]


def test_run_records_stop_changed_runs(spark, tmp_path):
    root, settings = str(tmp_path), {"threshold": 0.5, "grid": [1, 4]}
    with pytest.raises(KeyError):
        registry.require_run_record(spark, root, "r", settings, "")
    told = registry.write_run_record(spark, root, "r", settings)
    assert registry.write_run_record(spark, root, "r", dict(reversed(settings.items()))) == told
    registry.require_run_record(spark, root, "r", settings, told)
    with pytest.raises(ValueError, match="other settings"):
        registry.write_run_record(spark, root, "r", {"threshold": 0.6})
    with pytest.raises(ValueError, match="other settings"):
        registry.require_run_record(spark, root, "r", {**settings, "threshold": 0.6}, told)
    spark.createDataFrame([('{"threshold":0.4}',)], "value string").write.mode("overwrite").text(f"{root}/runs/r")
    with pytest.raises(ValueError, match="changed"):
        registry.require_run_record(spark, root, "r", settings, told)


def test_stored_rules(spark, tmp_path):
    table, path = [("b", 2, "x$", "two"), ("a", 1, "^x", "one")], f"{tmp_path}/rules"
    rules.write_rules(spark, path, table, ["one", "two"])
    assert rules.read_rules(spark, path, ["one", "two"]) == [table[1], table[0]]
    found = rules.classify_by(spark.createDataFrame([("X1",), ("1X",), (None,)], "n string"), lambda df: F.lower(df.n), rules.read_rules(spark, path, ["one", "two"]))
    assert {r.n: (r.outcome, r.rule_id) for r in found.collect()} == {"X1": ("one", "a"), "1X": ("two", "b"), None: (None, None)}
    with pytest.raises(ValueError, match="vocabulary"):
        rules.read_rules(spark, path, ["one"])
    for bad, what in (([("a", 1, "x", "one")] * 2, "same id"), ([("a", 1, "(", "one")], "cannot be read"), ([("a", None, "x", "one")], "lacks")):
        with pytest.raises(ValueError, match=what):
            rules.write_rules(spark, f"{tmp_path}/bad", bad, ["one"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        rules.write_rules(spark, path, table, ["one", "two"])


def test_stale_results_are_not_read(spark, tmp_path):
    made = []
    build = lambda df: (made.append(1), df.groupBy().count())[1]
    old, new = spark.range(5), spark.range(6)
    how = lambda df, **more: versions.cached(df, str(tmp_path), {"a": 1}, build, **more)[1]
    assert [how(old), how(old.orderBy(F.desc("id"))), how(new), how(new, rebuild=False), how(old)] == ["built", "fresh", "built", "fresh", "fresh"]
    assert len(made) == 2
    with pytest.raises(KeyError):
        how(spark.range(7), rebuild=False)
    assert versions.cached(old, str(tmp_path), {"a": 2}, build)[1] == "built"


def test_stream_of_shuffled_batches_equals_the_batch(spark, tmp_path):
    """Rows come in any order within the watermark, in many micro-batches; later ones are dropped."""
    r = random.Random(1)
    frames = [(k, i, r.choice([0.2, 1.2, 1.6, 2.4])) for k in "ab" for i in range(200) if r.random() < 0.93]
    table = spark.createDataFrame(frames, "signal string, frame long, z double").withColumn("time", F.timestamp_seconds(F.col("frame") * 3600))
    want = sorted((q.signal, q.start, q.stop) for q in hysteresis(table, ["signal"], "frame", F.col("z") > 2.0, F.col("z") > 1.0).collect())
    src = str(tmp_path / "frames")
    by_time = sorted(frames, key=lambda f: (f[1] // 25, r.random()))
    ends = [(k, i, 0.0) for k in "ab" for i in (200, 260)]
    for at in range(0, len(by_time), 40):
        part = by_time[at : at + 40]
        spark.createDataFrame(part, "signal string, frame long, z double").withColumn("time", F.timestamp_seconds(F.col("frame") * 3600)).coalesce(1).write.mode("append").parquet(src)
    for part in (ends, [("a", 3, 9.9)]):  # the last row is far too late
        spark.createDataFrame(part, "signal string, frame long, z double").withColumn("time", F.timestamp_seconds(F.col("frame") * 3600)).coalesce(1).write.mode("append").parquet(src)
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = log_stream(session, src, table.schema, files_per_trigger=1)
    found = hysteresis_stream(stream, "signal", "frame", "time", F.col("z") > 2.0, F.col("z") > 1.0, late="26 hours")
    to_table(found, str(tmp_path / "runs"), str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted(tuple(q) for q in spark.read.schema("signal string, start long, stop long").parquet(str(tmp_path / "runs")).collect())
    assert got == want


def test_sessions_of_a_stream(spark, tmp_path):
    from driftglass.streaming.replay import sessions

    rows = [("a", m) for m in (0, 10, 25, 90, 95)] + [("b", m) for m in (5, 200)] + [("z", 5_000)]
    table = spark.createDataFrame(rows, "k string, m long").withColumn("t", F.timestamp_seconds(F.col("m") * 60))
    table.coalesce(1).write.parquet(str(tmp_path / "log"))
    found = sessions(log_stream(spark, str(tmp_path / "log"), table.schema), "t", "k")
    to_table(found, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = sorted((q.k, int(q.start.timestamp()) // 60, int(q.stop.timestamp()) // 60, q.n) for q in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, 55, 3), ("a", 90, 125, 2), ("b", 5, 35, 1), ("b", 200, 230, 1)]
