"""Queries of beat trains, aligned regressors, decimation, exact quantiles, sequential tests, and stored models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftglass.operators import alignment, boosting, decimation, harm, quantiles, registry, rules
from driftglass.operators import beats as B
from driftglass.operators.signal import finite_runs, peaks
from driftglass.sources import versions
from driftglass.sources.shared import shared_folder, staged
from driftglass.streaming.replay import log_stream, to_table
from driftglass.streaming.runs import hysteresis_stream

from .base import SCORED, query, scored, table
from .detection import ENTER, HYST, LEAVE
from .kernels import FEATURES, features, filled
from .records import RULES

SEARCH = B.Search(first=2.0, second=0.6, distance=6, plausible=(6, 60), half=3, chunk=4096, halo=512)


def beat_train(spark, sf, **shapes):
    return B.trains(filled(spark, sf), ["signal"], "frame", "x", SEARCH, **shapes)


@query("beat_rescue")
def beat_rescue(spark, sf):
    """Peaks of each signal, and weaker ones found again where the train has holes."""
    return beat_train(spark, sf)[0].withColumnRenamed("at", "frame")


@query("beat_gaps")
def beat_gaps(spark, sf):
    """Intervals in which expected peaks were not found."""
    return beat_train(spark, sf)[1]


@query("template_search")
def template_search(spark, sf):
    """The second look by two shapes, of narrow and of wide peaks, and a floor that all but a twentieth of the peaks reach."""
    found, gaps = beat_train(spark, sf, kind=F.col("width") > 4, floor=0.05)
    beats = found.select("signal", F.col("at").alias("frame"), F.lit(None).cast("long").alias("stop"), "tag")
    return beats.unionByName(gaps.select("signal", F.col("start").alias("frame"), "stop", F.lit("gap").alias("tag")))


@query("aligned_regressor")
def aligned_regressor(spark, sf):
    """What a signal's mean peak, laid at every peak with its lag, takes out of it; even days make the shape."""
    x = filled(spark, sf)
    marks = B.trains(x, ["signal"], "frame", "x", SEARCH)[0].select("signal", F.col("at").alias("frame"), (F.expr("at div 24") % 2 == 0).alias("fit"))
    _, laid = alignment.aligned_regressor(x, marks, ["signal"], "frame", "x", 6, 2, 4096, 64)
    fit = alignment.subtracted(laid, ["signal"], F.expr("at div 24") % 2 == 1)
    return fit.select("signal", "n_fit", *(F.round(c, 9).alias(c) for c in ("coefficient", "rms_before", "rms_after", "survival")))


def decimation_sql(source: str, out: str, r: int) -> str:
    """One stage over (signal, frame, x) on a full grid from 0: filled, reflected through the end points, filtered at each r-th frame."""
    n, w = 20 * r, "PARTITION BY signal ORDER BY frame"
    at = "CASE WHEN x IS NOT NULL THEN frame END"
    return f"""{out}_o AS (SELECT list_transform(range({n} + 1), lambda m: CASE WHEN m = {n // 2} THEN 1 ELSE sin(pi() * 0.8 / {r} * (m - {n // 2})) / (pi() * 0.8 / {r} * (m - {n // 2})) END * (0.54 - 0.46 * cos(2 * pi() * m / {n}))) AS o),
{out}_h AS (SELECT list_transform(o, lambda t: t / list_sum(o)) AS o FROM {out}_o), {out}_g AS (SELECT list_transform(range(2 * {n} + 1), lambda k: list_sum(list_transform(range(greatest(0, k - {n}), least(k, {n}) + 1), lambda m: o[m + 1] * o[k - m + 1]))) AS g FROM {out}_h),
{out}_f AS (SELECT *, last_value(x IGNORE NULLS) OVER p AS pv, last_value({at} IGNORE NULLS) OVER p AS pf, first_value(x IGNORE NULLS) OVER q AS nv, first_value({at} IGNORE NULLS) OVER q AS nf FROM {source} WINDOW p AS ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{out}_l AS (SELECT signal, list(CASE WHEN pf IS NULL THEN nv WHEN nf IS NULL OR nf = pf THEN pv ELSE pv + (nv - pv) * (frame - pf) / (nf - pf) END ORDER BY frame) AS v, list(x ORDER BY frame) AS x, count(*) AS n FROM {out}_f GROUP BY 1),
{out}_e AS (SELECT signal, x, n, list_concat(list_concat(list_transform(range({n}), lambda k: 2 * v[1] - v[{n} - k + 1]), v), list_transform(range({n}), lambda k: 2 * v[n] - v[n - k - 1])) AS e FROM {out}_l),
{out}_j AS (SELECT *, unnest(range(n // {r})) AS j FROM {out}_e), {out} AS (SELECT signal, j AS frame, CASE WHEN list_count(x[j * {r} + 1 : j * {r} + {r}]) = {r} THEN list_dot_product(g, e[j * {r} + 1 : j * {r} + {2 * n + 1}]) END AS x FROM {out}_j, {out}_g)"""


GRID = f"{SCORED}, ends AS (SELECT signal, min(frame) AS lo, max(frame) AS hi FROM scored GROUP BY 1), slots AS (SELECT signal, lo, unnest(range(lo, hi + 1)) AS frame FROM ends), full_ AS (SELECT s.signal, s.frame - lo AS frame, x FROM slots s LEFT JOIN scored USING (signal, frame))"


@query("decimated", f"WITH {GRID}, {decimation_sql('full_', 'third', 3)}, {decimation_sql('third', 'sixth', 2)} SELECT signal, frame, round(x, 6) AS x FROM sixth WHERE x IS NOT NULL")
def decimated(spark, sf):
    """Each signal at a sixth of its rate, in two stages."""
    return decimation.decimate(filled(spark, sf), ["signal"], "frame", "x", [3, 2], chunk=4096).withColumn("x", F.round("x", 6))


SHARES = (0.05, 0.5, 0.95)


@query("exact_quantiles", "WITH s AS (SELECT event_type AS signal, value FROM events WHERE value IS NOT NULL) " + " UNION ALL ".join(f"SELECT signal, {s}::DOUBLE AS share, count(*) AS n, round(quantile_cont(value, {s}), 9) AS quantile FROM s GROUP BY 1" for s in SHARES))
def exact_quantiles(spark, sf):
    """Quantiles of all values of each signal by counting in bins; no task holds a signal's values."""
    found = quantiles.exact_quantiles(table(spark, sf, "events").withColumnRenamed("event_type", "signal"), ["signal"], "value", list(SHARES))
    return found.withColumn("quantile", F.round("quantile", 9))


def in_stretches(x: np.ndarray) -> np.ndarray:
    """Peaks of each finite stretch."""
    return np.concatenate([np.zeros(0, int), *(lo + peaks(x[lo:hi], 1.0, 6) for lo, hi in finite_runs(x) if hi - lo > 2)])


@query("harm_trials")
def harm_trials(spark, sf):
    """How often a bump costs or moves a peak, in rounds of 50 until an exact bound decides."""
    trial = harm.Trial(block=50, most=200, threshold=0.3, near=8, moved=1, chunk=1024, halo=256)
    found = harm.sequential_harm(filled(spark, sf), ["signal"], "frame", "x", in_stretches, np.hanning(9), [0.5, 1.0, 2.0], trial)
    return found.withColumn("share", F.round("share", 9))


def grouped(spark, sf, parts):
    """Labelled rows with ``part``, one of a few by a hash of the id; written once, as each fit reads them."""
    rows = features(spark, sf).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("string"))
    return staged(rows, shared_folder(spark, "labelled"), "rows")


@query("continued_fit")
def continued_fit(spark, sf):
    """Trees fitted on one half of the documents and continued on all of the other half's rows, which weigh twice."""
    rows = features(spark, sf).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    first = boosting.fit(boosting.balanced(rows.where("half = 0"), "y", 0.5), FEATURES, "y", "weight", boosting.Settings(trees=4))
    both = boosting.balanced(rows, "y", 0.5).withColumn("weight", F.col("weight") * F.when(F.col("half") == 1, 2.0).otherwise(1.0))
    model = boosting.fit(both, FEATURES, "y", "weight", boosting.Settings(trees=3), start=first)
    before = first.score(rows, "before").select("doc_id", F.round("before", 9).alias("before"))
    return model.score(rows, "after").select("doc_id", "y", F.round("after", 9).alias("after")).join(before, "doc_id")


@query("chosen_weights")
def chosen_weights(spark, sf):
    """For each language: inner F1 of each weight of its own rows, and the weight they choose."""
    rows, out = grouped(spark, sf, 2), []
    for lang in boosting.groups_of(rows, "lang", 16):
        grid = [1.0, 4.0]
        found, chosen, _ = boosting.choose_weight(rows, F.col("lang") == lang, "part", grid, FEATURES, settings=boosting.Settings(trees=3), adapt=boosting.Settings(trees=2))
        out.append(boosting.pooled_f1(found, ["w"], "y", "p").select(F.lit(lang).alias("lang"), "w", F.round("f1", 9).alias("f1"), "n_folds", F.lit(chosen).alias("chosen")))
    return boosting._union(out, spark, "lang string, w double, f1 double, n_folds long, chosen double")


@query("nested_search")
def nested_search(spark, sf):
    """The trials of a seeded search inside each held-out language, with the one that was chosen."""
    return boosting.nested(grouped(spark, sf, 2), "lang", "part", FEATURES, boosting.random_search(2, depths=(1, 3), trees=(1, 2)))[1].withColumn("f1", F.round("f1", 9))


@query("registry_scores")
def registry_scores(spark, sf):
    """A recorded run fits a pooled model, registers it under its content id, loads it again and scores all rows."""
    rows, root = features(spark, sf).withColumn("version", F.lit("1")), shared_folder(spark, "registry")
    settings = {"features": FEATURES, "trees": 3, "threshold": 0.5}
    record = registry.write_run_record(spark, root, "pooled", settings)
    model = boosting.fit(boosting.balanced(rows, "y", 0.5), FEATURES, "y", "weight", boosting.Settings(trees=settings["trees"]))
    registry.require_run_record(spark, root, "pooled", settings, record)
    spec = registry.Spec(model.content_id(), registry.POOLED, None, "1", versions.table_hash(rows.select("doc_id", "y")))
    registry.register(spark, root, model, spec, "query", {"spec": spec.__dict__, "run": record})
    scores = registry.infer(rows, root, spec.model_id, "lang", "version", "query")
    return scores.select("doc_id", "lang", F.round("p", 9).alias("p"), "model_id", "mode", "corpus_hash", "chosen_by")


@query(
    "stored_rules",
    "WITH r(rule_id, priority, pattern, outcome) AS (VALUES ('r1', 1, 'spam', 'block'), ('r2', 2, '^https', 'secure'), ('r3', 2, '^http:', 'plain'), ('r4', 3, '/en/', 'english'), ('r5', 2, 'html$', 'page')), m AS (SELECT page_id, rule_id, priority, outcome, min(priority) OVER (PARTITION BY page_id) AS best FROM pages, r WHERE regexp_matches(regexp_replace(lower(url), '#top$', ''), pattern)) SELECT page_id, CASE WHEN count(DISTINCT outcome) > 1 THEN 'ambiguous' ELSE min(outcome) END AS outcome, min(rule_id) AS rule_id FROM m WHERE priority = best GROUP BY 1",
)
def stored_rules(spark, sf):
    """Rules written to a table, read back, checked, and applied to what an extractor makes of each page."""
    path, outcomes = f"{shared_folder(spark, 'rules')}/rules", ["block", "secure", "plain", "english", "page"]
    rules.write_rules(spark, path, RULES, outcomes)
    found = rules.classify_by(table(spark, sf, "pages").select("page_id", "url"), lambda rows: F.lower(rows["url"]), rules.read_rules(spark, path, outcomes), ["#top"])
    return found.where("outcome is not null").select("page_id", "outcome", "rule_id")


@query("cached_rates", "SELECT event_type AS signal, count(*) AS n, round(avg(value), 6) AS mean, 'built' AS first, 'fresh' AS again, 'built' AS changed FROM events GROUP BY 1")
def cached_rates(spark, sf):
    """Rates per signal kept under a hash of the events and the settings: read again for the same, made again for others."""
    rows, root = table(spark, sf, "events").select("event_id", "event_type", "value"), shared_folder(spark, "cache")
    build = lambda df: df.groupBy(F.col("event_type").alias("signal")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    _, first = versions.cached(rows, root, {"step": 1}, build)
    found, again = versions.cached(rows, root, {"step": 1}, build)
    _, changed = versions.cached(rows.where("event_id <> 0"), root, {"step": 1}, build)
    return found.withColumns({"first": F.lit(first), "again": F.lit(again), "changed": F.lit(changed)})


@query("stream_runs", f"WITH {HYST} SELECT signal, start, stop FROM hyst")
def stream_runs(spark, sf):
    """Hysteresis runs by a stream with state and timers; a frame that does not pass closes each signal's last run."""
    root = shared_folder(spark, "stream")
    z = scored(spark, sf).select("signal", "frame", "z")
    ends = z.groupBy("signal").agg(F.max("frame").alias("last"))
    closing = ends.select("signal", F.explode(F.array(F.col("last") + 1, F.col("last") + 10)).alias("frame"), F.lit(None).cast("double").alias("z"))
    rows = z.unionByName(closing).withColumn("time", F.timestamp_seconds(F.col("frame") * 3600))
    rows.write.parquet(f"{root}/frames")
    conf, store = spark.newSession(), "spark.sql.streaming.stateStore.providerClass"
    conf.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    frames = log_stream(conf, f"{root}/frames", rows.schema, files_per_trigger=1_000_000)
    found = hysteresis_stream(frames, "signal", "frame", "time", F.col("z") > ENTER, F.col("z") > LEAVE, late="5 hours")
    to_table(found, f"{root}/runs", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema("signal string, start long, stop long").parquet(f"{root}/runs")
