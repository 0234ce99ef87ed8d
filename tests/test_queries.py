"""Every registered core query against its SQL on the smallest tables; and the driver contract."""

from __future__ import annotations

import glob
import itertools
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from driftglass.plans import catalog

SF = "/root/testdata/sf0.001"


#: Queries that SQL cannot state, and where their operators are held against an independent result.
ELSEWHERE = {
    "template_trains": "test_numeric", "injection_harm": "test_numeric",
    "run_modes": "here", "adapted_modes": "here", "gbt_fit": "here", "inner_cv": "here", "feature_importance": "here",
    "beat_rescue": "test_beats", "beat_gaps": "test_beats", "template_search": "test_beats", "aligned_regressor": "test_beats", "harm_trials": "test_beats", "peak_damage": "test_pluggable",
    "continued_fit": "test_models", "chosen_weights": "test_models", "nested_search": "test_models", "registry_scores": "test_models",
}


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def normal(rows):
    clean = lambda v: None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = normal(tuple(r[c] for c in names) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert name in ELSEWHERE, "neither SQL nor a test of its own"
        return
    want = sql.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert rows == normal(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.count() > 0 and found.columns[:2] == ["start_frame", "stop_frame"]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_run_modes_holds_out_every_language(spark):
    from driftglass.plans.kernels import features

    got = catalog.QUERIES["run_modes"](spark, SF).collect()
    want = features(spark, SF).collect()
    assert {r.lang for r in want} == {"de", "en", "es", "fr"}
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in want)


def test_adapted_modes_keep_admitted_rows_apart(spark):
    from driftglass.plans.kernels import features

    got = catalog.QUERIES["adapted_modes"](spark, "/root/testdata/sf0.01").collect()
    rows = features(spark, "/root/testdata/sf0.01").collect()
    declared = min(r.source for r in rows)
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    assert {r.doc_id for r in got if r.status == "admitted"} == {r.doc_id for r in rows if r.source == declared}
    for r in got:
        assert (r.p is not None and r.model is not None) == (r.status == "scored")


def test_a_target_without_both_classes_is_refused(spark):
    from driftglass.operators import learning as L

    rows = spark.createDataFrame([(g, float(i % 2 if g == "a" else 1), float(i), i < 5) for g in "ab" for i in range(20)], "g string, y double, x double, ok boolean")
    got = L.adapted(rows, ["x"], "g", ["a", "b"], rows.ok, 0.5, trees=1).groupBy("g", "status").count().collect()
    assert {(r.g, r.status): r["count"] for r in got} == {("a", "admitted"): 5, ("a", "scored"): 15, ("b", "admitted"): 5, ("b", "refused"): 15}


def test_models_rank_what_they_learned(spark):
    from driftglass.operators import learning as L

    rows = spark.createDataFrame([(i, float(i % 97), float(i * 7 % 13), float(i % 97 > 48), f"g{i % 20}") for i in range(2000)], "id long, a double, b double, y double, g string")
    train = L.weighted(rows, "y", 0.5)
    model = L.boosted(["a", "b"], trees=2, depth=2).fit(train)
    by = {r.feature: r["drop"] for r in L.permutation_importance(model, rows, ["a", "b"], "y").collect()}
    assert by["a"] > 0.1 > abs(by["b"]) * 10
    assert max(L.tuned(train, ["a", "b"], "g", 2, [1, 2]).avgMetrics) > 0.99
    held = L.scores(model, rows).select("y", "p").collect()
    assert sum((r.p > 0.5) == (r.y == 1) for r in held) > 1980


def test_crossfit_leaves_the_own_group_out(spark):
    from driftglass.operators import learning as L

    data = [(i, i % 10 / 10, float(i * 7 % 3 == 0), f"g{i % 4}") for i in range(200)]
    rows = spark.createDataFrame(data, "id long, p double, y double, g string")
    for r in L.crossfit(rows, "p", "y", "g", bins=5).collect():
        others = [y for _, p, y, g in data if g != r.g and int(p * 5) == int(r.p * 5)]
        assert r.crossfit == pytest.approx(sum(others) / len(others))
    fitted = sorted((r.p, r.calibrated) for r in L.isotonic_calibrated(rows, "p", "y").collect())
    assert all(0 <= a[1] <= b[1] <= 1 for a, b in zip(fitted, fitted[1:], strict=False))


def test_gbt_fit_scores_rows_it_was_not_fitted_on(spark):
    from driftglass.operators import learning as L
    from driftglass.plans.kernels import FEATURES, features

    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["gbt_fit"](spark, sf).collect()
    rows = features(spark, sf).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows.collect())
    for half in (0, 1):
        train, held = rows.where(F.col("half") != half), rows.where(F.col("half") == half)
        model = L.boosted(FEATURES, trees=5).fit(L.weighted(train, "y", 0.5))
        want = {r.doc_id: r.p for r in L.scores(model, held).collect()}
        assert {r.doc_id: r.p for r in got if r.half == half} == pytest.approx(want, abs=1e-6)
    ranked = sorted((r.p, r.y) for r in got)
    below = wins = ties = 0
    for p, y in ranked:
        if y == 1:
            wins += sum(q < p for q, z in ranked if z == 0)
            ties += sum(q == p for q, z in ranked if z == 0)
            below += 1
    negatives = len(ranked) - below
    assert (wins + ties / 2) / (below * negatives) > 0.6  # held out


def test_inner_cv_and_importance_of_the_queries(spark):
    """Areas under the curve recounted over the held-out rows of each fold; importance of the query's own rows."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from driftglass.operators import learning as L
    from driftglass.plans.kernels import FEATURES, features

    sf = "/root/testdata/sf0.01"
    rows = L.folds(L.weighted(features(spark, sf).withColumn("group", F.concat_ws("|", "lang", "source")), "y", 0.5), "group", 2).cache()
    for r in catalog.QUERIES["inner_cv"](spark, sf).collect():
        areas = []
        for fold in (0, 1):
            model = L.boosted(FEATURES, depth=r.depth).fit(rows.where(F.col("fold") != fold))
            areas.append(BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="_raw").evaluate(model.transform(rows.where(F.col("fold") == fold))))
        assert r.auc == pytest.approx(sum(areas) / 2, abs=0.02)
    by = {r.feature: r["drop"] for r in catalog.QUERIES["feature_importance"](spark, sf).collect()}
    assert set(by) == set(FEATURES) and max(by.values()) > 0


def test_route_events_adds_up_in_the_order_of_rows(spark, tmp_path):
    """Means at the limit of 0.08 fall on either side of it by the order of their sums; files and splits are many."""
    ways = sorted(set(itertools.permutations([0.1, 0.04, 0.08, 0.1, 0.05, 0.11])))  # their mean is 0.08
    rows = [(i, 30.0 + k, way[k]) for k in range(6) for i, way in enumerate(ways)]
    connection = duckdb.connect()
    connection.sql("set threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(6):  # each file has a row of every order; later files are larger, so that Spark reads them first
        values = ", ".join(f"({o}::BIGINT, {q}::DOUBLE, {d}::DOUBLE)" for o, q, d in rows[len(ways) * k : len(ways) * (k + 1)])
        connection.sql(f"copy (select * from (values {values}) t(l_orderkey, l_quantity, l_discount) union all select 1000 + range, 20 + range / 7, 0.05 from range({2000 * k})) to '{tmp_path}/lineitem.parquet/{k}.parquet'")
    connection.sql(f"copy (select range as o_orderkey from range({len(ways)})) to '{tmp_path}/orders.parquet'")
    connection.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    connection.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    want = sorted(connection.sql(catalog.ORACLE_SQL["route_events"]).fetchall())
    assert {route for _, route in want} == {"line", "reject"}
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")
    try:
        assert sorted(map(tuple, catalog.QUERIES["route_events"](spark, str(tmp_path)).collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
