"""Queries that SQL cannot state: filters, peaks, spectra, fitted models and exact bounds. Rows only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftglass.functions import distributions
from driftglass.operators import detectors as D
from driftglass.operators import learning as L
from driftglass.operators import runs as R
from driftglass.operators import signal as K
from driftglass.operators.ranking import holm
from driftglass.sources.shared import shared_folder, staged

from .base import LOGS, SCORED, query, scored, table
from .metrics import LAB, labelled

RATE = 24.0  # frames a day


def filled(spark, sf):
    """Each signal's scores on its full grid of frames, from 0; missing frames are null."""
    z = scored(spark, sf).select("signal", "frame", "x")
    bounds = z.groupBy("signal").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    grid = bounds.select("signal", "lo", F.explode(F.sequence("lo", "hi")).alias("frame"))
    return grid.join(z, ["signal", "frame"], "left").select("signal", (F.col("frame") - F.col("lo")).alias("frame"), "x")


def in_chunks(chunk: int, halo: int) -> str:
    """Finite frames of each signal, counted from its first, in chunks with halos: c (signal, chunk, own, frame, x), and the runs of frames in a row."""
    return f"""{SCORED}, b AS (SELECT signal, min(frame) AS lo FROM scored GROUP BY 1), x AS (SELECT signal, frame - lo AS frame, x FROM scored JOIN b USING (signal) WHERE x IS NOT NULL),
o AS (SELECT *, frame // {chunk} AS own, frame % {chunk} AS inside FROM x), e AS (SELECT signal, frame, x, own, unnest([own, CASE WHEN inside < {halo} AND own > 0 THEN own - 1 END, CASE WHEN inside >= {chunk - halo} THEN own + 1 END]) AS chunk FROM o),
c AS (SELECT signal, chunk, own = chunk AS own, frame, x, frame - row_number() OVER (PARTITION BY signal, chunk ORDER BY frame) AS run FROM e WHERE chunk IS NOT NULL),
centres AS (SELECT signal, chunk, quantile_cont(x, 0.5) AS mid FROM c GROUP BY 1, 2), sigmas AS (SELECT signal, chunk, any_value(mid) AS mid, 1.4826 * quantile_cont(abs(x - mid), 0.5) AS sigma FROM c JOIN centres USING (signal, chunk) GROUP BY 1, 2)"""


def zero_phase_sql(sos: np.ndarray, chunk: int, halo: int) -> str:
    """z (signal, frame, x, y) for the own frames of each chunk: two sections in a row, forward and then backward, each started at rest on
    the level of the first value of a run of finite frames."""

    def one_way(source: str, out: str) -> str:
        start, first, then = [], "x", []
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sos.tolist()):
            gain = (b0 + b1 + b2) / (1 + a1 + a2) if abs(1 + a1 + a2) > 1e-12 else 0.0
            level, before = f"({first}) * {gain!r}", first
            start += [f"({b1!r}) * ({before}) - ({a1!r}) * ({level}) + ({b2!r}) * ({before}) - ({a2!r}) * ({level}) AS s{k}", f"({b2!r}) * ({before}) - ({a2!r}) * ({level}) AS t{k}"]
            then += [f"({b1!r}) * {'x' if not k else f'y{k - 1}'} - ({a1!r}) * y{k} + t{k} AS s{k}", f"({b2!r}) * {'x' if not k else f'y{k - 1}'} - ({a2!r}) * y{k} AS t{k}"]
            first = level
        keys = "signal, chunk, run"
        return f"""{out} AS (SELECT {keys}, i, frame, {first} AS y, {", ".join(start)} FROM {source} WHERE i = 1 UNION ALL
SELECT {keys}, i, frame, y1, {", ".join(then)} FROM (SELECT *, ({sos[1][0].item()!r}) * y0 + s1 AS y1 FROM (SELECT n.*, s0, t0, s1, t1, ({sos[0][0].item()!r}) * n.x + s0 AS y0 FROM {out} f JOIN {source} n ON n.signal = f.signal AND n.chunk = f.chunk AND n.run = f.run AND n.i = f.i + 1)))"""

    order = "row_number() OVER (PARTITION BY signal, chunk, run ORDER BY frame"
    return f"""{in_chunks(chunk, halo)}, ahead AS (SELECT *, {order}) AS i FROM c), {one_way("ahead", "there")}, turned AS (SELECT signal, chunk, run, frame, y AS x, {order} DESC) AS i FROM there), {one_way("turned", "back")},
slots AS (SELECT signal, unnest(range(0, max(frame) + 1)) AS frame FROM (SELECT signal, frame - lo AS frame FROM scored JOIN b USING (signal)) GROUP BY 1),
z AS (SELECT s.signal, s.frame, c.x, back.y FROM slots s LEFT JOIN c ON c.signal = s.signal AND c.frame = s.frame AND c.own LEFT JOIN back ON back.signal = c.signal AND back.chunk = c.chunk AND back.frame = c.frame)"""


BAND, DAILY = K.butterworth(2, 0.08, 0.5, RATE), K.butterworth(2, 0.9, 1.1, RATE)


@query("band_filter", f"WITH RECURSIVE {zero_phase_sql(BAND, 512, 128)} SELECT signal, frame, CASE WHEN abs(y) < 5e-7 THEN 0 ELSE round(y, 6) END AS y FROM z")
def band_filter(spark, sf):
    """Zero-phase band-pass from two to twelve days' periods."""
    return K.per_chunk(filled(spark, sf), ["signal"], "frame", "x", K.zero_phase(BAND), chunk=512, halo=128).withColumn("y", F.when(F.abs("y") < 5e-7, 0.0).otherwise(F.round("y", 6)))  # no zero with a sign


@query("notch_filter", f"WITH RECURSIVE {zero_phase_sql(DAILY, 512, 128)} SELECT signal, frame, round(x - y, 6) AS y FROM z")
def notch_filter(spark, sf):
    """A daily rhythm taken out: the signal less its narrow band."""
    return K.per_chunk(filled(spark, sf), ["signal"], "frame", "x", lambda x: x - K.zero_phase(DAILY)(x), chunk=512, halo=128).withColumn("y", F.round("y", 6))


PEAKS = f"""WITH RECURSIVE {in_chunks(512, 64)}, n AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS z FROM c WINDOW w AS (PARTITION BY signal, chunk, run ORDER BY frame)),
tops AS (SELECT n.*, sigma FROM n JOIN sigmas USING (signal, chunk) WHERE x > a AND x >= z AND sigma > 0),
edges AS (SELECT t.signal, t.chunk, t.run, t.frame, max(h.frame) FILTER (h.frame < t.frame) AS l, min(h.frame) FILTER (h.frame > t.frame) AS r FROM tops t JOIN c h ON h.signal = t.signal AND h.chunk = t.chunk AND h.run = t.run AND h.x > t.x GROUP BY 1, 2, 3, 4),
lowest AS (SELECT t.signal, t.chunk, t.run, t.frame, min(v.x) FILTER (v.frame <= t.frame) AS left_, min(v.x) FILTER (v.frame >= t.frame) AS right_ FROM tops t LEFT JOIN edges e USING (signal, chunk, run, frame) JOIN c v ON v.signal = t.signal AND v.chunk = t.chunk AND v.run = t.run AND v.frame > coalesce(l, -1) AND v.frame < coalesce(r, 1000000000) GROUP BY 1, 2, 3, 4),
high AS (SELECT *, row_number() OVER (PARTITION BY signal, chunk, run ORDER BY x DESC, frame) AS i FROM tops JOIN lowest USING (signal, chunk, run, frame) WHERE x - greatest(left_, right_) >= 1.2 * sigma),
f AS (SELECT signal, chunk, run, 0::BIGINT AS i, []::BIGINT[] AS kept FROM (SELECT DISTINCT signal, chunk, run FROM high) UNION ALL SELECT f.signal, f.chunk, f.run, h.i, CASE WHEN len(list_filter(kept, lambda q: abs(q - h.frame) < 6)) = 0 THEN list_append(kept, h.frame) ELSE kept END FROM f JOIN high h ON h.signal = f.signal AND h.chunk = f.chunk AND h.run = f.run AND h.i = f.i + 1),
done AS (SELECT signal, chunk, run, unnest(max_by(kept, i)) AS frame FROM f GROUP BY 1, 2, 3)
SELECT signal, frame, round(x, 6) AS height FROM done JOIN high USING (signal, chunk, run, frame) WHERE own"""


@query("beat_peaks", PEAKS)
def beat_peaks(spark, sf):
    return K.find_peaks(filled(spark, sf), ["signal"], "frame", "x", 1.2, 6, chunk=512, halo=64).withColumn("height", F.round("height", 6))


SPECTRA = f"""WITH {SCORED}, b AS (SELECT signal, min(frame) AS lo FROM scored GROUP BY 1), v AS (SELECT signal, (frame - lo) // 240 AS part, frame, x FROM scored JOIN b USING (signal) WHERE x IS NOT NULL),
y AS (SELECT signal, part, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY signal, part) AS n, x - avg(x) OVER (PARTITION BY signal, part) AS y FROM v WINDOW w AS (PARTITION BY signal, part ORDER BY frame)),
h AS (SELECT *, y * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS w FROM y WHERE n >= 48), k AS (SELECT unnest(range(121)) AS k),
f AS (SELECT signal, part, n, k, pow(sum(w * cos(2 * pi() * k * i / n)), 2) + pow(sum(w * sin(2 * pi() * k * i / n)), 2) AS power FROM h JOIN k ON k <= n // 2 GROUP BY 1, 2, 3, 4),
p AS (SELECT *, power / sum(power) OVER (PARTITION BY signal, part) AS p FROM f), c AS (SELECT *, sum(p) OVER (PARTITION BY signal, part ORDER BY k) AS upto FROM p),
s AS (SELECT signal, part, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(count(*)) AS entropy, min(24.0 * k / n) FILTER (upto >= 0.95) AS edge, sum(p) FILTER (abs(24.0 * k / n - 1) <= 1) AS line FROM c GROUP BY 1, 2),
r AS (SELECT a.signal, a.part, a.n, b.i - a.i AS l, sum(a.y * b.y) AS r FROM h a JOIN h b ON a.signal = b.signal AND a.part = b.part AND b.i - a.i BETWEEN 0 AND 122 GROUP BY 1, 2, 3, 4),
q AS (SELECT *, r / max(r) FILTER (l = 0) OVER (PARTITION BY signal, part) AS q FROM r), g AS (SELECT *, lag(q) OVER (PARTITION BY signal, part ORDER BY l) AS a, lead(q) OVER (PARTITION BY signal, part ORDER BY l) AS c FROM q),
t AS (SELECT signal, part, max_by({{'l': l, 'a': a, 'b': q, 'c': c}}, (q, -l)) AS t FROM g WHERE l >= 6 AND l < least(121, n - 2) GROUP BY 1, 2),
e AS (SELECT signal, part, t, CASE WHEN t.a - 2 * t.b + t.c <> 0 THEN 0.5 * (t.a - t.c) / (t.a - 2 * t.b + t.c) ELSE 0 END AS shift FROM t)
SELECT signal, part, round(entropy, 6) AS entropy, round(edge, 6) AS edge, round(line, 6) AS line, round(24.0 / (t.l + shift), 6) AS rate, round(t.b - 0.25 * (t.a - t.c) * shift, 6) AS height FROM s JOIN e USING (signal, part)"""


@query("spectral_features", SPECTRA)
def spectral_features(spark, sf):
    """Entropy, edge, line share and autocorrelation rate per signal and stretch of 240 frames."""

    def features(key: tuple, rows: pa.Table) -> pa.Table:
        x = rows.sort_by("frame")["x"].drop_null().to_numpy()
        if len(x) < 48:
            return pa.table({n: pa.array([], t) for n, t in (("signal", pa.string()), ("part", pa.int64()), *((n, pa.float64()) for n in ("entropy", "edge", "line", "rate", "height")))})
        s = K.spectrum_features(x, RATE, 1.0)
        rate, height = K.autocorr_rate(x, RATE, 0.2, 4.0)
        return pa.table({"signal": [key[0].as_py()], "part": [key[1].as_py()], **{k: [v] for k, v in s.items()}, "rate": [rate], "height": [height]})

    rows = filled(spark, sf).withColumn("part", F.expr("frame div 240"))
    found = rows.groupBy("signal", "part").applyInArrow(features, "signal string, part long, entropy double, edge double, line double, rate double, height double")
    return found.select("signal", "part", *(F.round(c, 6).alias(c) for c in ("entropy", "edge", "line", "rate", "height")))


def features(spark, sf):
    lab = labelled(spark, sf).withColumn("y", F.col("y").cast("double"))
    text = table(spark, sf, "documents").select("doc_id", (F.length(F.regexp_replace("text", "[A-Za-z]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("odd"), F.size(F.split("text", "\n")).cast("double").alias("lines"))
    return lab.join(text, "doc_id").select("doc_id", "source", "lang", "y", F.col("n_chars").cast("double").alias("n_chars"), "odd", "lines")


FEATURES = ["n_chars", "odd", "lines"]


def stored_features(spark, sf):
    """Written once: every fit reads them."""
    return staged(features(spark, sf), shared_folder(spark, "features"), "rows")


@query("gbt_fit")
def gbt_fit(spark, sf):
    """Weighted boosted trees, fitted twice: each half of the documents, by a hash of the id, is scored by the model of the
    other."""
    rows = stored_features(spark, sf).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    out = []
    for half in (0, 1):
        model = L.boosted(FEATURES, trees=5).fit(L.weighted(rows.where(F.col("half") != half), "y", 0.5))
        out.append(L.scores(model, rows.where(F.col("half") == half)).select("doc_id", "y", F.round("p", 6).alias("p"), "half"))
    return out[0].unionByName(out[1])


@query("run_modes")
def run_modes(spark, sf):
    """Held-out scores per language, each held out in turn, with the id of the model that gave them."""
    rows = stored_features(spark, sf)
    targets = sorted(r.lang for r in rows.select("lang").where("lang is not null").distinct().collect())
    return L.leave_one_out(rows, ["n_chars", "odd", "lines"], "lang", targets, 0.5, trees=3).select("doc_id", "lang", "y", "p", "model")


@query("adapted_modes")
def adapted_modes(spark, sf):
    """Scores per language by a model that also learned from the language's rows of one declared source, the first by
    name; those rows are kept apart and not scored."""
    rows = stored_features(spark, sf)
    targets = sorted(r.lang for r in rows.select("lang").where("lang is not null").distinct().collect())
    admitted = F.col("source") == F.lit(rows.agg(F.min("source")).first()[0])
    return L.adapted(rows, FEATURES, "lang", targets, admitted, 0.5, trees=3).select("doc_id", "lang", "y", "p", "status", "model")


@query("inner_cv")
def inner_cv(spark, sf):
    """Area under the curve of two tree depths over folds that no group of language and source is split by."""
    rows = L.weighted(stored_features(spark, sf).withColumn("group", F.concat_ws("|", "lang", "source")), "y", 0.5)
    depths = [2, 4]
    found = L.tuned(rows, FEATURES, "group", 2, depths).avgMetrics
    return spark.createDataFrame([(d, float(m)) for d, m in zip(depths, found, strict=True)], "depth int, auc double")


@query("feature_importance")
def feature_importance(spark, sf):
    """What the error of the fitted trees gains when one feature at a time is permuted."""
    rows = stored_features(spark, sf)
    model = L.boosted(FEATURES, trees=5).fit(L.weighted(rows, "y", 0.5))
    return L.permutation_importance(model, rows, FEATURES, "y").withColumn("drop", F.round("drop", 9))


CALIBRATED = f"""WITH {LAB}, b AS (SELECT doc_id, p, y, source, least(floor(p * 20), 19) AS bin FROM lab), c AS (SELECT doc_id, p, round((sum(y) OVER (PARTITION BY bin) - sum(y) OVER (PARTITION BY source, bin))::DOUBLE / nullif(count(*) OVER (PARTITION BY bin) - count(*) OVER (PARTITION BY source, bin), 0), 6) AS crossfit FROM b),
v AS (SELECT p, count(*) AS w, sum(y)::DOUBLE AS s, row_number() OVER (ORDER BY p) AS i FROM b GROUP BY p), u AS (SELECT p, i, sum(w) OVER (ORDER BY i) AS cw, sum(s) OVER (ORDER BY i) AS cs, w, s FROM v),
m AS (SELECT x.i AS a, z.i AS b, (z.cs - x.cs + x.s) / (z.cw - x.cw + x.w) AS mean FROM u x JOIN u z ON z.i >= x.i),
low AS (SELECT a, b, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM m), fit AS (SELECT b AS i, max(least) OVER (PARTITION BY b ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fit FROM low QUALIFY a = b)
SELECT c.doc_id, c.p, crossfit, round(greatest(0, least(1, fit)), 6) AS calibrated FROM c JOIN v ON v.p = c.p JOIN fit ON fit.i = v.i"""


@query("crossfit_calibrate", CALIBRATED)
def crossfit_calibrate(spark, sf):
    rows = labelled(spark, sf).withColumn("y", F.col("y").cast("double"))
    found = L.isotonic_calibrated(L.crossfit(rows, "p", "y", "source"), "p", "y")
    return found.select("doc_id", "p", F.round("crossfit", 6).alias("crossfit"), F.round("calibrated", 6).alias("calibrated"))


BOUNDS = f"""WITH RECURSIVE {LAB}, c AS (SELECT lang, count(*) FILTER (p >= 0.25) AS k, count(*) AS n FROM lab WHERE y = 1 GROUP BY 1),
t AS (SELECT lang, k, n, kind, CASE kind WHEN 'hi' THEN k + 1 ELSE k END AS first_, CASE kind WHEN 'lo' THEN 0.025 WHEN 'hi' THEN 0.975 ELSE 0.05 END AS goal FROM c, (VALUES ('lo'), ('hi'), ('lower')) AS v(kind)),
r AS (SELECT *, 0 AS step, 0.0::DOUBLE AS a, 1.0::DOUBLE AS z FROM t UNION ALL SELECT lang, k, n, kind, first_, goal, step + 1, CASE WHEN tail < goal THEN mid ELSE a END, CASE WHEN tail < goal THEN z ELSE mid END FROM (SELECT *, (a + z) / 2 AS mid, list_sum(list_transform(range(first_, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a + z) / 2) + (n - i) * ln(1 - (a + z) / 2)))) AS tail FROM r WHERE step < 40)),
e AS (SELECT lang, k, n, kind, CASE WHEN kind <> 'hi' AND k = 0 THEN 0.0 WHEN kind = 'hi' AND k = n THEN 1.0 ELSE (a + z) / 2 END AS v FROM r WHERE step = 40)
SELECT lang, k, n, round(max(v) FILTER (kind = 'lo'), 6) AS lo, round(max(v) FILTER (kind = 'hi'), 6) AS hi, round(max(v) FILTER (kind = 'lower'), 6) AS lower FROM e GROUP BY 1, 2, 3"""


@query("recall_bounds", BOUNDS)
def recall_bounds(spark, sf):
    """Exact bounds of the recall per language: counts are aggregated, the bounds are a small function of them."""
    counts = labelled(spark, sf).where("y = 1").groupBy("lang").agg(F.count_if(F.col("p") >= 0.25).alias("k"), F.count("*").alias("n"))

    @F.arrow_udf("struct<lo: double, hi: double, lower: double>")
    def bounds(k: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([{**dict(zip(("lo", "hi"), distributions.clopper_pearson(a, b), strict=True)), "lower": distributions.one_sided_lower(a, b)} for a, b in zip(k.to_pylist(), n.to_pylist(), strict=True)], pa.struct([(c, pa.float64()) for c in ("lo", "hi", "lower")]))

    return counts.select("lang", "k", "n", bounds("k", "n").alias("b")).select("lang", "k", "n", *(F.round(f"b.{c}", 6).alias(c) for c in ("lo", "hi", "lower")))


CHANCES = f"""WITH RECURSIVE {LAB}, g AS (SELECT lang, source, avg(p) AS p FROM lab GROUP BY 1, 2), o AS (SELECT lang, p, row_number() OVER (PARTITION BY lang ORDER BY p) AS i FROM g),
t AS (SELECT lang, 0::BIGINT AS i, [1.0::DOUBLE] AS d FROM (SELECT DISTINCT lang FROM g)
UNION ALL SELECT t.lang, o.i, list_transform(range(len(t.d) + 1), lambda k: coalesce(t.d[k + 1], 0) * (1 - o.p) + CASE WHEN k > 0 THEN t.d[k] * o.p ELSE 0 END) FROM t JOIN o ON o.lang = t.lang AND o.i = t.i + 1),
z AS (SELECT lang, unnest(range(len(d)))::INTEGER AS hits, unnest(d) AS chance FROM t WHERE i = (SELECT max(i) FROM o WHERE o.lang = t.lang))
SELECT lang, hits, round(chance, 9) AS chance FROM z"""


@query("chance_bounds", CHANCES)
def chance_bounds(spark, sf):
    """The distribution of hits where each group has its own chance."""
    ps = labelled(spark, sf).groupBy("lang", "source").agg(F.avg("p").alias("p")).groupBy("lang").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    found = ps.select("lang", F.posexplode(distributions.poisson_binomial(F.col("ps"))).alias("hits", "chance"))
    return found.withColumn("chance", F.round("chance", 9))


TABLES = ("customer", "documents", "events", "labels", "lineitem", "orders", "pages")


@query("scan_files", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, count(DISTINCT {c}) AS ids FROM {t}" for t, c in zip(TABLES, ("c_custkey", "doc_id", "event_id", "doc_id", "l_orderkey", "o_orderkey", "page_id"), strict=True)))
def scan_files(spark, sf):
    """The tables with their rows and distinct ids, read from their files."""
    ids = dict(zip(TABLES, ("c_custkey", "doc_id", "event_id", "doc_id", "l_orderkey", "o_orderkey", "page_id"), strict=True))
    parts = [table(spark, sf, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.count_distinct(c).alias("ids")) for t, c in ids.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def excursions(spark, sf):
    return D.per_stretch(filled(spark, sf), ["signal"], "frame", "x", lambda x: D.spikes(x, 2.0, 3), chunk=240, halo=24)


SPIKES = f"""{in_chunks(240, 24)}, n AS (SELECT c.*, sigma, abs(x - mid) AS y, lag(abs(x - mid)) OVER w AS a, lead(abs(x - mid)) OVER w AS z FROM c JOIN sigmas USING (signal, chunk) WINDOW w AS (PARTITION BY signal, chunk, run ORDER BY frame)),
far AS (SELECT *, row_number() OVER (PARTITION BY signal, chunk ORDER BY frame) AS i FROM n WHERE y > a AND y >= z AND y > 2 * sigma AND sigma > 0),
f AS (SELECT signal, chunk, i, frame, frame AS kept FROM far WHERE i = 1 UNION ALL SELECT h.signal, h.chunk, h.i, h.frame, CASE WHEN h.frame - f.kept >= 3 THEN h.frame ELSE f.kept END FROM f JOIN far h ON h.signal = f.signal AND h.chunk = f.chunk AND h.i = f.i + 1),
train AS (SELECT signal, frame, x AS height FROM f JOIN far USING (signal, chunk, frame) WHERE kept = frame AND own)"""


@query("spike_train", f"WITH RECURSIVE {SPIKES} SELECT signal, frame, round(height, 6) AS height FROM train")
def spike_train(spark, sf):
    """Excursions beyond two robust sigmas, by stretches of 240 frames."""
    return excursions(spark, sf).withColumn("height", F.round("height", 6))


LOCKED = f"""WITH RECURSIVE {SPIKES}, g AS (SELECT signal, frame // 240 AS part, frame - lag(frame) OVER (PARTITION BY signal, frame // 240 ORDER BY frame) AS gap FROM train),
t AS (SELECT signal, part, count(*) AS n_spikes, count(gap) AS m_intervals, count(*) FILTER (round_even(gap / 24.0, 0) >= 1 AND abs(gap - 24 * round_even(gap / 24.0, 0)) <= 2) AS k_locked FROM g GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN m_intervals >= 3 THEN least(1, list_sum(list_transform(range(k_locked, m_intervals + 1), lambda j: exp(lgamma(m_intervals + 1) - lgamma(j + 1) - lgamma(m_intervals - j + 1) + j * ln(1 / 6.0) + (m_intervals - j) * ln(5 / 6.0))))) END AS p FROM t),
r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY signal) AS m FROM q WHERE p IS NOT NULL WINDOW w AS (PARTITION BY signal ORDER BY p, part)),
u AS (SELECT *, bool_and(p <= 0.05 / (m - i + 1)) OVER (PARTITION BY signal ORDER BY i) AS distrusted FROM r)
SELECT signal, part, n_spikes, m_intervals, k_locked, 'tested' AS status, round(p, 9) AS p, distrusted FROM u UNION ALL SELECT signal, part, n_spikes, m_intervals, k_locked, 'untested_few_spikes', NULL, false FROM q WHERE p IS NULL"""


@query("line_tests", LOCKED)
def line_tests(spark, sf):
    """Stretches of 240 frames whose excursions keep a daily rhythm: tested one by one, rejected as a family per signal."""
    train = excursions(spark, sf).withColumn("part", F.expr("frame div 240"))
    tests = D.lock_tests(train, ["signal"], "part", "frame", RATE, 2.0, 3)
    judged = holm(tests.where("status = 'tested'"), ["signal"], "p", 0.05, ["part"]).withColumnRenamed("rejected", "distrusted")
    return judged.unionByName(tests.where("status <> 'tested'").withColumn("distrusted", F.lit(False))).withColumn("p", F.round("p", 9))


@query("template_trains")
def template_trains(spark, sf):
    """Frames whose surroundings look like the mean peak of their stretch."""
    find = lambda x: D.template_train(x, D.spikes(x, 1.5, 6), 3, 0.75, 6)
    return D.per_stretch(filled(spark, sf), ["signal"], "frame", "x", find, chunk=240, halo=24)


@query("injection_harm")
def injection_harm(spark, sf):
    """Peaks kept, lost and added when a bump is added every 60 frames, per signal and stretch."""

    def apply(key: tuple, rows: pa.Table) -> pa.Table:
        x = rows.sort_by("frame")["x"].drop_null().to_numpy()
        kept, lost, added = D.harm(x, np.hanning(7), np.arange(20, len(x), 60), 0.3, 4, 1) if len(x) > 30 else (0, 0, 0)
        return pa.table({"signal": [key[0].as_py()], "part": [key[1].as_py()], "kept": [kept], "lost": [lost], "added": [added]})

    rows = filled(spark, sf).withColumn("part", F.expr("frame div 240"))
    return rows.groupBy("signal", "part").applyInArrow(apply, "signal string, part long, kept long, lost long, added long")


@query("half_height_width", f"WITH {LOGS}, t AS (SELECT signal, max_by(frame, (x, -frame)) AS peak, max(x) AS top, min(x) AS low FROM logs GROUP BY 1), f AS (SELECT l.signal, l.frame FROM logs l JOIN t USING (signal) WHERE x >= low + (top - low) / 2), g AS (SELECT *, frame - row_number() OVER (PARTITION BY signal ORDER BY frame) AS g FROM f), r AS (SELECT signal, min(frame) AS start, max(frame) + 1 AS stop FROM g GROUP BY signal, g) SELECT r.signal, r.start, r.stop - r.start AS width FROM r JOIN t ON t.signal = r.signal AND t.peak >= r.start AND t.peak < r.stop")
def half_height_width(spark, sf):
    """The run at or above half height that holds the highest frame."""
    x = scored(spark, sf).select("signal", "frame", "x")
    t = x.groupBy("signal").agg(F.max(F.struct("x", (-F.col("frame")).alias("f"))).alias("m"), F.min("x").alias("low"))
    t = t.select("signal", (-F.col("m.f")).alias("peak"), F.col("m.x").alias("top"), "low")
    high = x.join(t, "signal").where(F.col("x") >= F.col("low") + (F.col("top") - F.col("low")) / 2).select("signal", "frame")
    found = R.true_runs(high, ["signal"], "frame").join(t, "signal").where("peak >= start and peak < stop")
    return found.select("signal", "start", (F.col("stop") - F.col("start")).alias("width"))
