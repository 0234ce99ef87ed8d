"""Estimates: combinations, fits, templates, histograms, correlations, verdicts and the report."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.functions.robust import correlation, ratio
from driftglass.operators import estimation as S
from driftglass.operators import evaluation as E
from driftglass.operators.candidates import Settings, candidates
from driftglass.operators.joins import overlap_join

from .base import FRAMES, LOGS, SCORED, events, frames, query, scored, table
from .detection import DRIVER, ENTER, HITS, HYST, LEAVE, rounded
from .matching import MARKED, PURCHASES, SIGNUPS, hyst, marks, of_type
from .metrics import LAB, labelled

NAMES = ["click", "error", "purchase", "signup", "view"]
WIDE = f"{FRAMES}, wide AS (SELECT frame, " + ", ".join(f"max(rms) FILTER (signal = '{n}') AS {n}" for n in NAMES) + " FROM frames GROUP BY 1)"


def wide(spark, sf):
    return frames(spark, sf).groupBy("frame").pivot("signal", NAMES).agg(F.max("rms"))


@query("tripole_projection", f"WITH {WIDE} SELECT frame, round(0.5 * click + 0.5 * view - error, 6) AS tripole FROM wide")
def tripole_projection(spark, sf):
    """a V1 + b V3 - V2; missing if any of the three is."""
    return rounded(wide(spark, sf).select("frame", (0.5 * F.col("click") + 0.5 * F.col("view") - F.col("error")).alias("tripole")), "tripole")


@query("common_average_ref", f"WITH {FRAMES}, r AS (SELECT frame, avg(rms) AS ref, count(*) AS k FROM frames GROUP BY 1) SELECT signal, frame, round(rms - ref, 6) AS x, k FROM frames JOIN r USING (frame)")
def common_average_ref(spark, sf):
    """The mean over the channels present at a frame, subtracted."""
    w = Window.partitionBy("frame")
    return rounded(frames(spark, sf).select("signal", "frame", (F.col("rms") - F.avg("rms").over(w)).alias("x"), F.count("*").over(w).alias("k")), "x")


@query("weighted_combination", f"WITH {FRAMES}, w(signal, weight) AS (VALUES ('click', 0.5), ('view', 0.25), ('error', -0.75)) SELECT frame, round(sum(weight * rms), 6) AS x, count(*) AS members FROM frames JOIN w USING (signal) GROUP BY 1 HAVING count(*) = 3")
def weighted_combination(spark, sf):
    """A linear recipe given as data; incomplete frames are not computed."""
    return rounded(S.combine(frames(spark, sf), {"click": 0.5, "view": 0.25, "error": -0.75}, "signal", ["frame"], "rms"), "x")


@query("tripole_weight", f"WITH {WIDE}, d AS (SELECT click - error AS a, view - error AS b FROM wide WHERE click IS NOT NULL AND view IS NOT NULL AND error IS NOT NULL) SELECT round((var_pop(b) - covar_pop(a, b)) / (var_pop(a) + var_pop(b) - 2 * covar_pop(a, b)), 6) AS weight, count(*) AS n FROM d")
def tripole_weight(spark, sf):
    """The weight that makes the combination's variance least."""
    d = wide(spark, sf).select((F.col("click") - F.col("error")).alias("a"), (F.col("view") - F.col("error")).alias("b")).dropna()
    va, vb, c = F.var_pop("a"), F.var_pop("b"), F.covar_pop("a", "b")
    return d.agg(F.round((vb - c) / (va + vb - 2 * c), 6).alias("weight"), F.count("*").alias("n"))


@query("leak_fit", f"WITH {WIDE}, p AS (SELECT frame, click AS y, view AS x FROM wide WHERE click IS NOT NULL AND view IS NOT NULL), k AS (SELECT sum(x * y) / sum(x * x) AS k FROM p) SELECT round(any_value(k), 6) AS k, round(sqrt(avg(y * y)), 6) AS before, round(sqrt(avg((y - k * x) * (y - k * x))), 6) AS after FROM p, k")
def leak_fit(spark, sf):
    """One regressor by least squares, subtracted."""
    p = wide(spark, sf).select(F.col("click").alias("y"), F.col("view").alias("x")).dropna()
    s = p.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("n"))
    k = F.col("xy") / F.col("xx")
    return rounded(s.select(k.alias("k"), F.sqrt(F.col("yy") / F.col("n")).alias("before"), F.sqrt((F.col("yy") - k * F.col("xy")) / F.col("n")).alias("after")), "k", "before", "after")


@query("multi_leak_fit", f"WITH {WIDE}, p AS (SELECT click AS y, view AS a, error AS b FROM wide WHERE click IS NOT NULL AND view IS NOT NULL AND error IS NOT NULL), s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy, count(*) AS n FROM p) SELECT round((ay * bb - byy * ab) / (aa * bb - ab * ab), 6) AS k1, round((byy * aa - ay * ab) / (aa * bb - ab * ab), 6) AS k2, n FROM s")
def multi_leak_fit(spark, sf):
    """Two regressors by the normal equations; only their sums leave the tasks."""
    return rounded(S.two_regressors(wide(spark, sf).select("click", "view", "error").dropna(), "click", "view", "error"), "k1", "k2")


@query("template_snr", f"WITH {FRAMES}, b AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS f FROM events WHERE event_type = 'purchase' AND value > 100), o AS (SELECT signal, frame - f AS lag, rms FROM b JOIN frames ON frame - f BETWEEN -3 AND 3), t AS (SELECT signal, lag, avg(rms) AS m, stddev_samp(rms) / sqrt(count(*)) AS se, count(*) AS n FROM o GROUP BY 1, 2) SELECT signal, round((max(m) - min(m)) / avg(se), 6) AS snr, sum(n)::BIGINT AS n FROM t GROUP BY 1")
def template_snr(spark, sf):
    """Event-aligned mean over its standard error."""
    t = S.aligned(frames(spark, sf), events(spark, sf).where("event_type = 'purchase' and value > 100").select(F.expr("us div 3600000000").alias("at")).distinct(), "frame", "rms", ["signal"], 3)
    return t.groupBy("signal").agg(F.round((F.max("mean") - F.min("mean")) / F.avg("se"), 6).alias("snr"), F.sum("n").alias("n"))


@query("peri_event_average", f"WITH {FRAMES}, b AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS f FROM events WHERE event_type = 'purchase' AND value > 100), o AS (SELECT signal, frame - f AS lag, rms FROM b JOIN frames ON frame - f BETWEEN -6 AND 6) SELECT signal, lag, round(avg(rms), 6) AS mean, count(*) AS n FROM o GROUP BY 1, 2")
def peri_event_average(spark, sf):
    t = S.aligned(frames(spark, sf), events(spark, sf).where("event_type = 'purchase' and value > 100").select(F.expr("us div 3600000000").alias("at")).distinct(), "frame", "rms", ["signal"], 6)
    return rounded(t.select("signal", "lag", "mean", "n"), "mean")


@query("peri_event_histogram", f"WITH {SIGNUPS}, {PURCHASES}, d AS (SELECT pu.t - su.t AS d FROM su JOIN pu USING (user_id) WHERE pu.t - su.t >= -41000 AND pu.t - su.t < 41000) SELECT floor((d + 41000) / 2000)::BIGINT AS bin, count(*) AS n FROM d GROUP BY 1")
def peri_event_histogram(spark, sf):
    """Times of one train around another in 41 bins."""
    s = of_type(spark, sf, "signup").select("user_id", (F.col("t") - 41_000).alias("start"), (F.col("t") + 41_000).alias("stop"), F.col("t").alias("at"))
    p = of_type(spark, sf, "purchase").select("user_id", F.col("t").alias("r_start"), (F.col("t") + 1e-6).alias("r_stop"))
    d = F.col("r_start") - F.col("at")
    return overlap_join(s, p, ["user_id"], 86_400.0).where((d >= -41_000) & (d < 41_000)).groupBy(F.floor((d + 41_000) / 2000).alias("bin")).agg(F.count("*").alias("n"))


@query("autocorr_lag", f"WITH {LOGS}, c AS (SELECT signal, frame, x - avg(x) OVER (PARTITION BY signal) AS x FROM logs), l AS (SELECT a.signal, b.frame - a.frame AS lag, avg(a.x * b.x) AS c FROM c a JOIN c b ON a.signal = b.signal AND b.frame - a.frame BETWEEN 1 AND 12 GROUP BY 1, 2), v AS (SELECT signal, avg(x * x) AS v FROM c GROUP BY 1) SELECT signal, lag, round(c / v, 6) AS r FROM l JOIN v USING (signal)")
def autocorr_lag(spark, sf):
    """Autocorrelation at small lags: each frame is sent to the lags it can meet."""
    return rounded(S.autocorrelation(scored(spark, sf).select("signal", "frame", "x"), ["signal"], "frame", "x", 12), "r")


@query("lead_pairs", f"WITH {FRAMES}, s AS (SELECT signal, count(*) AS n, avg(rms) AS m FROM frames GROUP BY 1) SELECT a.signal AS a, b.signal AS b, least(a.n, b.n) AS n, round(a.m - b.m, 6) AS d FROM s a JOIN s b ON a.signal < b.signal")
def lead_pairs(spark, sf):
    """All pairs of leads from one row per lead."""
    s = frames(spark, sf).groupBy("signal").agg(F.count("*").alias("n"), F.avg("rms").alias("m"))
    rows = s.agg(F.sort_array(F.collect_list(F.struct("signal", "n", "m"))).alias("s"))
    pairs = rows.select(F.posexplode("s").alias("i", "a"), "s").select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.select(F.col("a.signal").alias("a"), F.col("b.signal").alias("b"), F.least("a.n", "b.n").alias("n"), F.round(F.col("a.m") - F.col("b.m"), 6).alias("d"))


@query("half_split", f"WITH {FRAMES}, h AS (SELECT signal, rms, ntile(2) OVER (PARTITION BY signal ORDER BY frame) AS half FROM frames) SELECT signal, half::INTEGER AS half, count(*) AS n, round(avg(rms), 6) AS m, round(quantile_cont(rms, 0.5), 6) AS med FROM h GROUP BY 1, 2")
def half_split(spark, sf):
    h = frames(spark, sf).withColumn("half", F.ntile(2).over(Window.partitionBy("signal").orderBy("frame")))
    return rounded(h.groupBy("signal", "half").agg(F.count("*").alias("n"), F.avg("rms").alias("m"), F.percentile("rms", F.lit(0.5)).alias("med")), "m", "med")


@query("core_features", f"WITH {HITS}, c AS (SELECT p.start, p.stop, count(DISTINCT p.signal) AS n_pairs, max(z.z) AS peak, avg(z.z) AS mean, kurtosis_pop(z.z) AS kurt FROM pairs p JOIN scored z ON z.frame >= p.start AND z.frame < p.stop AND z.signal = p.signal GROUP BY 1, 2) SELECT start, stop - start AS length, n_pairs, round(peak, 6) AS peak, round(mean, 6) AS mean FROM c")
def core_features(spark, sf):
    """Features of each candidate over the signals that entered in it."""
    z = scored(spark, sf)
    c = candidates(z, DRIVER).select("start", "stop", F.explode("signals").alias("signal"), F.size("signals").cast("long").alias("n_pairs"))
    cells = z.where("z is not null").select("signal", "z", F.col("frame").alias("r_start"), (F.col("frame") + 1).alias("r_stop"))
    got = overlap_join(c, cells, ["signal"], 64).groupBy("start", "stop").agg(F.max("n_pairs").alias("n_pairs"), F.max("z").alias("peak"), F.avg("z").alias("mean"))
    return rounded(got.select("start", (F.col("stop") - F.col("start")).alias("length"), "n_pairs", "peak", "mean"), "peak", "mean")


@query("calibrate_theta", f"WITH {FRAMES} SELECT signal, round(quantile_cont(rms, 0.95), 6) AS theta, count(*) AS n, count(*) FILTER (rms > (SELECT quantile_cont(g.rms, 0.95) FROM frames g WHERE g.signal = frames.signal)) AS over FROM frames GROUP BY 1")
def calibrate_theta(spark, sf):
    f = frames(spark, sf)
    theta = f.groupBy("signal").agg(F.percentile("rms", F.lit(0.95)).alias("theta"))
    return rounded(f.join(theta, "signal").groupBy("signal").agg(F.first("theta").alias("theta"), F.count("*").alias("n"), F.count_if(F.col("rms") > F.col("theta")).alias("over")), "theta")


@query("clip_frames", "WITH f AS (SELECT event_type AS signal, epoch_us(ts) // 3600000000 AS frame, avg((value >= 75)::INTEGER) AS share FROM events GROUP BY 1, 2) SELECT signal, frame, round(share, 6) AS share FROM f WHERE share >= 0.5")
def clip_frames(spark, sf):
    """Frames where at least half the samples are at the rail."""
    f = events(spark, sf).groupBy(F.col("event_type").alias("signal"), F.expr("us div 3600000000").alias("frame")).agg(F.avg((F.col("value") >= 75).cast("int")).alias("share"))
    return rounded(f.where("share >= 0.5"), "share")


@query("band_excess", f"WITH {HYST}, j AS (SELECT f.signal, f.rms, h.start IS NOT NULL AS inside FROM frames f LEFT JOIN hyst h ON h.signal = f.signal AND f.frame >= h.start AND f.frame < h.stop) SELECT signal, count(*) FILTER (inside) AS n_inside, round(sqrt(avg(rms * rms) FILTER (inside)) / sqrt(avg(rms * rms) FILTER (NOT inside)), 6) AS excess FROM j GROUP BY 1")
def band_excess(spark, sf):
    """Root mean square inside the spans over that outside."""
    cells = frames(spark, sf).select("signal", F.col("frame").alias("start"), (F.col("frame") + 1).alias("stop"), "rms")
    spans = hyst(spark, sf).select("signal", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    inside = overlap_join(cells, spans, ["signal"], 64).select("signal", "start", F.lit(True).alias("inside"))
    j = cells.join(inside, ["signal", "start"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    level = lambda c: F.sqrt(F.avg(F.when(c, F.col("rms") * F.col("rms"))))
    return rounded(j.groupBy("signal").agg(F.count_if("inside").alias("n_inside"), ratio(level(F.col("inside")), level(~F.col("inside"))).alias("excess")), "excess")


@query("route_events", "WITH e AS (SELECT o_orderkey, max(l_quantity) AS top, sqrt(greatest(0, avg(l_quantity * l_quantity) - 625)) / 25 AS resid, avg(l_discount) AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT o_orderkey, CASE WHEN top >= 50 THEN 'clip' WHEN line > 0.08 AND top > 30 THEN 'line' WHEN top < 20 THEN 'correct' WHEN resid < 0.5 THEN 'subtract' ELSE 'reject' END AS route FROM e")
def route_events(spark, sf):
    """Strict order: clipped, line-dominated, separable, subtracted, rejected. Means are compared with limits, so their
    doubles are added up in the order of the table's rows, whatever the partitions."""
    q, row = F.col("l_quantity"), ["_file", "_row"]
    so_far = Window.partitionBy("l_orderkey").orderBy(*row).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_discount", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    summed = lines.withColumns({"_squares": F.sum(q * q).over(so_far), "_discounts": F.sum("l_discount").over(so_far)})
    mean = lambda total, c: ratio(F.max_by(total, F.struct(*row)), F.count(c))
    e = summed.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(q).alias("top"), (F.sqrt(F.greatest(F.lit(0), mean("_squares", "l_quantity") - 625)) / 25).alias("resid"), mean("_discounts", "l_discount").alias("line"))
    e = e.join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return e.select("o_orderkey", F.when(F.col("top") >= 50, "clip").when((F.col("line") > 0.08) & (F.col("top") > 30), "line").when(F.col("top") < 20, "correct").when(F.col("resid") < 0.5, "subtract").otherwise("reject").alias("route"))


@query("group_balanced", f"WITH {LAB}, g AS (SELECT lang, source, avg(p) AS m, CASE WHEN count(*) >= 3 AND stddev_pop(p) > 0 AND stddev_pop(y) > 0 THEN corr(p, y) END AS r FROM lab GROUP BY 1, 2) SELECT lang, round(avg(m), 6) AS balanced, count(r) AS n_r, round(avg(r), 6) AS mean_r FROM g GROUP BY 1")
def group_balanced(spark, sf):
    """Means of group means, and guarded correlations."""
    g = labelled(spark, sf).groupBy("lang", "source").agg(F.avg("p").alias("m"), F.when((F.count("*") >= 3) & (F.stddev_pop("p") > 0) & (F.stddev_pop("y") > 0), correlation(F.col("p"), F.col("y").cast("double"))).alias("r"))
    return rounded(g.groupBy("lang").agg(F.avg("m").alias("balanced"), F.count("r").alias("n_r"), F.avg("r").alias("mean_r")), "balanced", "mean_r")


@query("shape_stats", f"WITH {FRAMES}, d AS (SELECT signal, rms, rms - lag(rms) OVER (PARTITION BY signal ORDER BY frame) AS d FROM frames) SELECT signal, round(max(abs(d)) / sqrt(avg(rms * rms)), 6) AS slew, round(kurtosis_pop(rms), 6) AS kurt, round(sum(abs(d)), 6) AS line FROM d GROUP BY 1")
def shape_stats(spark, sf):
    d = frames(spark, sf).withColumn("d", F.col("rms") - F.lag("rms").over(Window.partitionBy("signal").orderBy("frame")))
    return rounded(d.groupBy("signal").agg((F.max(F.abs("d")) / F.sqrt(F.avg(F.col("rms") * F.col("rms")))).alias("slew"), F.kurtosis("rms").alias("kurt"), F.sum(F.abs("d")).alias("line")), "slew", "kurt", "line")


@query("circular_linear", f"WITH {LOGS}, p AS (SELECT signal, x, cos(2 * pi() * (frame % 24) / 24) AS c, sin(2 * pi() * (frame % 24) / 24) AS s FROM logs), r AS (SELECT signal, corr(x, c) AS a, corr(x, s) AS b, corr(c, s) AS g FROM p GROUP BY 1) SELECT signal, round(sqrt((a * a + b * b - 2 * a * b * g) / (1 - g * g)), 6) AS r FROM r")
def circular_linear(spark, sf):
    """Correlation of a value with the phase of the day."""
    angle = 2 * pi * (F.col("frame") % 24) / 24
    p = scored(spark, sf).select("signal", "x", F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    r = p.groupBy("signal").agg(correlation(F.col("x"), F.col("c")).alias("a"), correlation(F.col("x"), F.col("s")).alias("b"), correlation(F.col("c"), F.col("s")).alias("g"))
    a, b, g = F.col("a"), F.col("b"), F.col("g")
    return rounded(r.select("signal", F.sqrt((a * a + b * b - 2 * a * b * g) / (1 - g * g)).alias("r")), "r")


@query("interp_calibrate", f"WITH {LAB}, k AS (SELECT * FROM (VALUES (0.0, 0.0), (0.2, 0.5), (0.5, 0.8), (1.0, 0.95)) v(x, y)), s AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM k) SELECT doc_id, round(CASE WHEN p >= 1 THEN 0.95 ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END, 6) AS q, round(ln((p + 1e-6) / (1 - p + 1e-6)), 6) AS logit FROM lab JOIN s ON p >= x0 AND (p < x1 OR (p >= 1 AND x1 = 1)) WHERE x1 IS NOT NULL")
def interp_calibrate(spark, sf):
    """Piecewise-linear calibration through breakpoints, and the logit."""
    p = F.col("p")
    q = S.piecewise(p, [(0.0, 0.0), (0.2, 0.5), (0.5, 0.8), (1.0, 0.95)])
    return rounded(labelled(spark, sf).select("doc_id", q.alias("q"), F.log((p + 1e-6) / (1 - p + 1e-6)).alias("logit")), "q", "logit")


@query("sweep_grid", "WITH a AS (SELECT DISTINCT p_brand FROM part), g AS (SELECT p_brand, unnest([0.5, 1.0, 2.0]) AS amp FROM a) SELECT p_brand, amp::DOUBLE AS amp, substr(sha256(p_brand || ':' || printf('%.1f', amp)), 1, 8) AS seed, row_number() OVER (ORDER BY amp * length(p_brand) DESC, p_brand) AS place FROM g")
def sweep_grid(spark, sf):
    """A parameter grid with seeds from its keys, the costliest points first."""
    g = table(spark, sf, "part").select("p_brand").distinct().select("p_brand", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("amp"))
    seed = F.substring(F.sha2(F.concat_ws(":", "p_brand", F.format_string("%.1f", "amp")).cast("binary"), 256), 1, 8)
    place = F.row_number().over(Window.orderBy((F.col("amp") * F.length("p_brand")).desc(), "p_brand")).cast("long")
    return g.select("p_brand", "amp", seed.alias("seed"), place.alias("place"))


@query("spearman", f"WITH {LAB}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0 AS b FROM lab) SELECT lang, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY 1")
def spearman(spark, sf):
    return rounded(S.spearman(labelled(spark, sf), ["lang"], "n_chars", "y"), "rho")


@query("wls_confound", f"WITH {LAB}, d AS (SELECT p AS y, toxic::DOUBLE AS x, 0.5 + n_chars / (n_chars + 1000.0) AS w FROM lab), s AS (SELECT sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, count(*) AS n FROM d) SELECT round((sw * sxy - sx * sy) / (sw * sxx - sx * sx), 6) AS slope, round((sxx * sy - sx * sxy) / (sw * sxx - sx * sx), 6) AS icept, n, n - 2 >= 10 AND sw * sxx - sx * sx > 1e-9 AS usable FROM s")
def wls_confound(spark, sf):
    """Weighted least squares by its normal equations; too few rows or no contrast is not usable."""
    w = 0.5 + F.col("n_chars") / (F.col("n_chars") + 1000.0)
    return rounded(S.weighted_line(labelled(spark, sf), F.col("toxic").cast("double"), F.col("p"), w), "slope", "icept")


@query("prior_weights", f"WITH {LAB}, g AS (SELECT count(*) AS n, sum(y)::DOUBLE AS pos FROM lab) SELECT y, count(*) AS n, round(CASE WHEN y = 1 THEN 0.5 * any_value(g.n) / any_value(pos) ELSE 0.5 * any_value(g.n) / (any_value(g.n) - any_value(pos)) END, 6) AS weight FROM lab, g GROUP BY 1")
def prior_weights(spark, sf):
    """Weights that bring the weighted prevalence to an external rate."""
    return rounded(S.prior_weights(labelled(spark, sf), "y", 0.5), "weight")


@query("diagnose_miss", f"WITH {SCORED}, {MARKED}, t AS (SELECT a, b, max(z) AS top, max_by(signal, (z, signal)) AS signal FROM marks LEFT JOIN scored ON frame >= a AND frame < b AND z IS NOT NULL GROUP BY 1, 2) SELECT a AS start, b AS stop, signal, CASE WHEN top IS NULL THEN 'not assessable' WHEN top > 2 THEN 'caught' WHEN top > 1 THEN 'below entry' ELSE 'below exit' END AS verdict FROM t")
def diagnose_miss(spark, sf):
    """Why a mark was missed: the largest score inside it."""
    m = marks(spark, sf).select(F.col("r_start").alias("start"), F.col("r_stop").alias("stop"))
    cells = scored(spark, sf).where("z is not null").select("signal", "z", F.col("frame").alias("r_start"), (F.col("frame") + 1).alias("r_stop"))
    top = overlap_join(m, cells, [], 64).groupBy("start", "stop").agg(F.max(F.struct("z", "signal")).alias("m"))
    z = F.col("m.z")
    verdict = F.when(z.isNull(), "not assessable").when(z > ENTER, "caught").when(z > LEAVE, "below entry").otherwise("below exit")
    return m.join(top, ["start", "stop"], "left").select("start", "stop", F.col("m.signal").alias("signal"), verdict.alias("verdict"))


@query("next_round_gate", "WITH l AS (SELECT user_id, max(epoch_us(ts)) FILTER (event_type = 'error') AS miss, max(epoch_us(ts)) FILTER (event_type = 'purchase') AS fix, count(*) FILTER (event_type = 'error') AS n FROM events GROUP BY 1) SELECT user_id, CASE WHEN miss IS NULL THEN 'open' WHEN fix IS NULL OR fix < miss THEN 'blocked' ELSE 'open' END AS gate, n FROM l")
def next_round_gate(spark, sf):
    """Open unless the last miss has no later fix."""
    us = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("us")))
    g = events(spark, sf).groupBy("user_id").agg(us("error").alias("miss"), us("purchase").alias("fix"), F.count_if(F.col("event_type") == "error").alias("n"))
    blocked = F.col("miss").isNotNull() & (F.col("fix").isNull() | (F.col("fix") < F.col("miss")))
    return g.select("user_id", F.when(blocked, "blocked").otherwise("open").alias("gate"), "n")


BOOT = f"{LAB}, c AS (SELECT source, count(*) AS n, count(*) FILTER (p >= 0.25 AND y = 1) AS tp, count(*) FILTER (y = 1) AS pos FROM lab GROUP BY 1), w AS (SELECT c.*, d, (('0x' || substr(md5(source || ':' || d), 1, 4))::INTEGER % 3) AS k FROM c, generate_series(1, 200) AS g(d)), b AS (SELECT d, sum(k * tp)::DOUBLE / nullif(sum(k * pos), 0) AS r FROM w GROUP BY 1)"


@query("cluster_bootstrap", f"WITH {BOOT} SELECT round(quantile_cont(r, 0.025), 6) AS lo, round(quantile_cont(r, 0.975), 6) AS hi, count(r) AS draws FROM b")
def cluster_bootstrap(spark, sf):
    """Cluster bootstrap of a ratio: draws are hash weights of the clusters, applied to summed counts."""
    return rounded(S.cluster_bootstrap(clusters(spark, sf), "source", "tp", "pos", 200), "lo", "hi")


def clusters(spark, sf):
    y = F.col("y") == 1
    return labelled(spark, sf).groupBy("source").agg(F.count_if(y & (F.col("p") >= 0.25)).alias("tp"), F.count_if(y).alias("pos"))


@query("verdicts", f"WITH {BOOT}, i AS (SELECT quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM b), m(target, bar) AS (VALUES ('low', 0.3), ('mid', 0.75), ('high', 0.99)) SELECT target, CASE WHEN lo >= bar THEN 'better' WHEN hi < bar THEN 'worse' ELSE 'undecided' END AS verdict FROM i, m")
def verdicts(spark, sf):
    """Margin and interval rules."""
    i = S.cluster_bootstrap(clusters(spark, sf), "source", "tp", "pos", 200)
    bars = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(b).alias("bar")) for t, b in (("low", 0.3), ("mid", 0.75), ("high", 0.99)))))
    return i.select("lo", "hi", bars.alias("m")).select("m.target", F.when(F.col("lo") >= F.col("m.bar"), "better").when(F.col("hi") < F.col("m.bar"), "worse").otherwise("undecided").alias("verdict"))


@query("acceptance_report", f"WITH {LAB}, x AS (SELECT (SELECT count(*) FROM events WHERE value = 0) AS zeros, (SELECT avg(y) FROM lab) AS balance, (SELECT count(DISTINCT lang) FROM documents) AS langs, (SELECT count(*) FROM lab WHERE p IS NULL) AS missing), r AS (SELECT 1 AS row_, 'zeros' AS name, CASE WHEN zeros = 0 THEN 'pass' ELSE 'fail' END AS status FROM x UNION ALL SELECT 2, 'balance', CASE WHEN balance IS NULL THEN 'not computable' WHEN balance >= 0.05 THEN 'pass' ELSE 'fail' END FROM x UNION ALL SELECT 3, 'languages', CASE WHEN langs >= 4 THEN 'pass' ELSE 'fail' END FROM x UNION ALL SELECT 4, 'velocity', 'not computable') SELECT row_, name, status, bool_and(status = 'pass') OVER () AS accepted FROM r")
def acceptance_report(spark, sf):
    """Rows that pass, fail or cannot be computed; accepted only if all pass, and an absent row does not."""
    lab = labelled(spark, sf)
    one = lambda df, n, name, ok: df.select(F.lit(n).alias("row_"), F.lit(name).alias("name"), E.status(ok).alias("status"))
    zeros = events(spark, sf).where("value = 0").agg(F.count("*").alias("v"))
    rows = one(zeros, 1, "zeros", F.col("v") == 0).union(one(lab.agg(F.avg("y").alias("v")), 2, "balance", F.col("v") >= 0.05))
    rows = rows.union(one(table(spark, sf, "documents").agg(F.count_distinct("lang").alias("v")), 3, "languages", F.col("v") >= 4))
    rows = rows.union(one(zeros, 4, "velocity", F.lit(None).cast("boolean")))
    return rows.withColumn("accepted", F.bool_and(F.col("status") == "pass").over(Window.partitionBy()))


@query("detect_region", f"WITH {HITS}, lo AS (SELECT min(frame) + 100 AS a, min(frame) + 400 AS b FROM frames) SELECT p.start, p.stop, count(DISTINCT p.signal) AS n_pairs, round(max(z.z), 6) AS peak_z FROM pairs p JOIN scored z ON z.signal = p.signal AND z.frame >= p.start AND z.frame < p.stop, lo WHERE p.start < lo.b AND p.stop > lo.a GROUP BY 1, 2")
def detect_region(spark, sf):
    """The whole detection of a recording, and the candidates that touch a region."""
    z = scored(spark, sf)
    first = z.agg(F.min("frame")).scalar()
    found = candidates(z, DRIVER).where((F.col("start") < first + 400) & (F.col("stop") > first + 100))
    return rounded(found.select("start", "stop", F.size("signals").cast("long").alias("n_pairs"), "peak_z"), "peak_z")


@query("isotonic", f"WITH {LAB}, b AS (SELECT least(floor(p * 20), 19)::INTEGER AS bin, y FROM lab), g AS (SELECT bin, avg(y) AS m, count(*) AS n FROM b GROUP BY 1), f AS (SELECT x.bin, max(v) AS fit FROM (SELECT i.bin, l.bin AS lo, (SELECT min(s.m) FROM (SELECT h.bin AS hi, (SELECT sum(k.m * k.n) / sum(k.n) FROM g k WHERE k.bin BETWEEN l.bin AND h.bin) AS m FROM g h WHERE h.bin >= i.bin) s) AS v FROM g i JOIN g l ON l.bin <= i.bin) x GROUP BY 1) SELECT bin, round(fit, 6) AS fit FROM f")
def isotonic(spark, sf):
    """Isotonic calibration: the bins' means, pooled where they fall."""
    g = labelled(spark, sf).groupBy(F.least(F.floor(F.col("p") * 20), F.lit(19)).cast("int").alias("bin")).agg(F.avg("y").alias("m"), F.count("*").alias("n"))
    return rounded(S.isotonic(g, "bin", "m", "n"), "fit")
