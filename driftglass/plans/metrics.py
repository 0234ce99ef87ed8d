"""Aggregates: scores, calibration, rates, budgets, gates and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.functions.robust import ratio
from driftglass.operators import evaluation as E

from .base import FRAMES, SCORED, events, frames, query, scored, table
from .detection import rounded

LAB = "lab AS (SELECT l.doc_id, quality AS y, toxic, source, lang, n_chars, least(n_chars / 4000.0::DOUBLE, 1.0::DOUBLE) AS p FROM labels l JOIN documents d USING (doc_id))"


def labelled(spark, sf):
    """Labels with a score: y is the truth, p grows with the document's length."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("p"))
    return table(spark, sf, "labels").withColumnRenamed("quality", "y").join(d, "doc_id")


@query("binary_scores", f"WITH {LAB}, c AS (SELECT lang, count(*) FILTER (y = 1 AND p >= 0.4) AS tp, count(*) FILTER (y = 0 AND p >= 0.4) AS fp, count(*) FILTER (y = 1 AND p < 0.4) AS fn, count(*) FILTER (y = 0 AND p < 0.4) AS tn FROM lab GROUP BY 1), a AS (SELECT * FROM c UNION ALL SELECT 'all', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT, sum(tn)::BIGINT FROM c) SELECT lang AS scope, tp, fp, fn, tn, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS prec, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS rec, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM a")
def binary_scores(spark, sf):
    return E.confusion(labelled(spark, sf), "y", F.col("p") >= 0.4, "lang")


@query("ece", f"WITH {LAB}, b AS (SELECT least(floor(p * 10), 9)::INTEGER AS bin, p, y FROM lab), g AS (SELECT bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS mean_y FROM b GROUP BY 1) SELECT bin, n, round(mean_p, 6) AS mean_p, round(mean_y, 6) AS mean_y, round(sum(n * abs(mean_p - mean_y)) OVER () / sum(n) OVER (), 6) AS ece FROM g")
def ece(spark, sf):
    return rounded(E.reliability(labelled(spark, sf), "p", "y"), "mean_p", "mean_y", "ece").withColumn("bin", F.col("bin").cast("int"))


@query("summarize_modes", f"WITH {LAB}, s AS (SELECT lang AS mode, source AS target, count(*) AS n, sum(y)::BIGINT AS pos, avg(abs(p - y)) AS err FROM lab GROUP BY 1, 2) SELECT mode, count(*) AS folds, sum(n)::BIGINT AS rows_, sum(pos)::BIGINT AS pos, round(avg(err), 6) AS macro_err, round(sum(err * n) / sum(n), 6) AS micro_err, min(pos) AS least_pos FROM s GROUP BY 1")
def summarize_modes(spark, sf):
    folds = labelled(spark, sf).groupBy(F.col("lang").alias("mode"), "source").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("err"))
    return rounded(folds.groupBy("mode").agg(F.count("*").alias("folds"), F.sum("n").alias("rows_"), F.sum("pos").alias("pos"), F.avg("err").alias("macro_err"), (F.sum(F.col("err") * F.col("n")) / F.sum("n")).alias("micro_err"), F.min("pos").alias("least_pos")), "macro_err", "micro_err")


@query("cohort_probe", f"WITH {LAB} SELECT lang, round(quantile_cont(p, 0.5) FILTER (toxic = 1) - quantile_cont(p, 0.5) FILTER (toxic = 0), 6) AS gap FROM lab GROUP BY 1")
def cohort_probe(spark, sf):
    """Difference of two groups' medians; null where a group is absent."""
    med = lambda c: F.percentile(F.when(c, F.col("p")), F.lit(0.5))
    return labelled(spark, sf).groupBy("lang").agg(F.round(med(F.col("toxic") == 1) - med(F.col("toxic") == 0), 6).alias("gap"))


@query("corpus_composition", f"WITH {LAB}, g AS (SELECT lang, source, count(*) AS n, sum(y)::BIGINT AS pos FROM lab GROUP BY 1, 2) SELECT lang, sum(n)::BIGINT AS n, sum(pos)::BIGINT AS pos, count(*) AS n_sources, string_agg(source || '=' || n, ',' ORDER BY source) AS counts FROM g GROUP BY 1")
def corpus_composition(spark, sf):
    g = labelled(spark, sf).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", "n"))), lambda x: F.concat_ws("=", x["source"], x["n"].cast("string"))), ",")
    return g.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.count("*").alias("n_sources"), listed.alias("counts"))


@query("eta_squared", f"WITH {LAB}, g AS (SELECT source, count(n_chars) AS n, avg(n_chars) AS m FROM lab GROUP BY 1 HAVING count(n_chars) >= 2), r AS (SELECT l.n_chars AS x, g.m FROM lab l JOIN g USING (source)), t AS (SELECT avg(x) AS mu FROM r) SELECT count(*) AS n, round(1 - sum((x - m) * (x - m)) / sum((x - mu) * (x - mu)), 6) AS eta2, 1 - sum((x - m) * (x - m)) / sum((x - mu) * (x - mu)) >= 0.999 AS leaks FROM r, t")
def eta_squared(spark, sf):
    return rounded(E.eta_squared(labelled(spark, sf), "n_chars", "source"), "eta2")


@query("stratified_rate", f"WITH {LAB}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (y = 1) AS flagged, count(*) FILTER (y = 0) AS rest, avg(toxic) FILTER (y = 0) AS r FROM lab GROUP BY 1) SELECT lang, n, round(flagged::DOUBLE / n + (1 - flagged::DOUBLE / n) * coalesce(r, 0), 6) AS rate, round(sum(flagged + rest * coalesce(r, 0)) OVER () / sum(n) OVER (), 6) AS pooled FROM g")
def stratified_rate(spark, sf):
    """f + (1 - f) r per stratum: all flagged rows, and the rate found among the others."""
    y = F.col("y") == 1
    g = labelled(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(y).alias("k"), F.coalesce(F.avg(F.when(~y, F.col("toxic"))), F.lit(0.0)).alias("r"))
    hits = F.col("k") + (F.col("n") - F.col("k")) * F.col("r")
    total = g.agg((F.sum(hits) / F.sum("n"))).scalar()
    return g.select("lang", "n", F.round(hits / F.col("n"), 6).alias("rate"), F.round(total, 6).alias("pooled"))


@query("budget_quantiles", "WITH c AS (SELECT user_id, count(*) AS n, sum(value) AS v FROM events GROUP BY 1) SELECT count(*) AS units, quantile_cont(n, 0.9) AS p90, round(quantile_cont(v, 0.99), 6) AS p99_value, quantile_cont(n, 0.9) <= 3000 AND count(*) >= 30 AS within FROM c")
def budget_quantiles(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    p90 = F.percentile("n", F.lit(0.9))
    return c.agg(F.count("*").alias("units"), p90.alias("p90"), F.round(F.percentile("v", F.lit(0.99)), 6).alias("p99_value"), ((p90 <= 3000) & (F.count("*") >= 30)).alias("within"))


@query("score_round", f"WITH {LAB}, g AS (SELECT source, lang, count(*) AS n, count(*) FILTER (p >= 0.25) AS found FROM lab WHERE y = 1 GROUP BY 1, 2) SELECT coalesce(source, 'all') AS source, coalesce(lang, 'all') AS lang, sum(n)::BIGINT AS n, sum(found)::BIGINT AS found, round(sum(found)::DOUBLE / sum(n), 6) AS recall FROM g GROUP BY GROUPING SETS ((source), (lang), ())")
def score_round(spark, sf):
    """Recall by group, by condition and overall: counts are summed, ratios never averaged."""
    g = labelled(spark, sf).where("y = 1")
    sets = g.groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.count_if(F.col("p") >= 0.25).alias("found"))
    return sets.select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("lang", F.lit("all")).alias("lang"), "n", "found", F.round(ratio(F.col("found"), F.col("n")), 6).alias("recall"))


@query("pooled_gate", "WITH r AS (SELECT o_orderpriority AS unit, year(o_orderdate) AS round, count(*) AS n, count(*) FILTER (o_totalprice < 250000) AS k FROM orders GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER w AS cn, sum(k) OVER w AS ck FROM r WINDOW w AS (PARTITION BY unit ORDER BY round ROWS UNBOUNDED PRECEDING)) SELECT unit, round::INTEGER AS round, cn::BIGINT AS n, ck::BIGINT AS k, CASE WHEN cn < 500 THEN 'too few' WHEN ck::DOUBLE / cn < 0.98 THEN 'below' ELSE 'pass' END AS status FROM s")
def pooled_gate(spark, sf):
    """Counts pooled over the rounds so far, and the first reason that holds."""
    year = F.year("o_orderdate").alias("round")
    r = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("unit"), year).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") < 250000).alias("k"))
    w = Window.partitionBy("unit").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    s = r.select("unit", "round", F.sum("n").over(w).alias("n"), F.sum("k").over(w).alias("k"))
    return s.withColumn("status", F.when(F.col("n") < 500, "too few").when(ratio(F.col("k"), F.col("n")) < 0.98, "below").otherwise("pass"))


@query("missing_rates", f"WITH {SCORED}, n AS (SELECT frame, max(z) FILTER (signal = 'click') AS click, max(z) FILTER (signal = 'view') AS view, max(z) FILTER (signal = 'error') AS error FROM scored GROUP BY 1) SELECT 'click' AS name, round(avg((click IS NULL)::INTEGER), 6) AS rate FROM n UNION ALL SELECT 'view', round(avg((view IS NULL)::INTEGER), 6) FROM n UNION ALL SELECT 'error', round(avg((error IS NULL)::INTEGER), 6) FROM n")
def missing_rates(spark, sf):
    names = ["click", "view", "error"]
    wide = scored(spark, sf).groupBy("frame").pivot("signal", names).agg(F.max("z"))
    rates = wide.agg(*(F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias(c) for c in names))
    return rates.unpivot([], names, "name", "rate")


@query("alias_table", "WITH s AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS token, p_name FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY p_name) AS i, count(*) OVER (PARTITION BY token) AS n FROM s) SELECT token, any_value(n) AS n, string_agg(p_name, ';' ORDER BY p_name) AS examples FROM r WHERE i <= 3 GROUP BY 1")
def alias_table(spark, sf):
    names = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("token"), "p_name").distinct()
    first = names.withColumn("i", F.row_number().over(Window.partitionBy("token").orderBy("p_name"))).where("i <= 3")
    examples = first.groupBy("token").agg(F.array_join(F.sort_array(F.collect_list("p_name")), ";").alias("examples"))
    return names.groupBy("token").agg(F.count("*").alias("n")).join(examples, "token")


@query("audit_summary", "WITH d AS (SELECT l_returnflag AS g, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT g, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM d GROUP BY 1")
def audit_summary(spark, sf):
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    d = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_returnflag").alias("g"), days.alias("x"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return d.groupBy("g").agg(F.count("*").alias("n"), q.alias("q")).select("g", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("med"), F.col("q")[2].alias("q3"))


@query("count_gate", "WITH m AS (SELECT event_type, epoch_us(ts) // 3600000000 AS h, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT event_type, quantile_cont(n, 0.5) AS ref FROM m GROUP BY 1) SELECT event_type, count(*) AS hours, round(avg(CASE WHEN abs(n - ref) <= 1 THEN 1.0 ELSE 0 END), 6) AS within, avg(CASE WHEN abs(n - ref) <= 1 THEN 1.0 ELSE 0 END) >= 0.6 AS passed FROM m JOIN r USING (event_type) GROUP BY 1")
def count_gate(spark, sf):
    m = events(spark, sf).groupBy("event_type", F.expr("us div 3600000000").alias("h")).agg(F.count("*").alias("n"))
    r = m.groupBy("event_type").agg(F.percentile("n", F.lit(0.5)).alias("ref"))
    within = F.avg(F.when(F.abs(F.col("n") - F.col("ref")) <= 1, 1.0).otherwise(0.0))
    return m.join(r, "event_type").groupBy("event_type").agg(F.count("*").alias("hours"), F.round(within, 6).alias("within"), (within >= 0.6).alias("passed"))


@query("implausible_fraction", "WITH d AS (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 1000000.0::DOUBLE AS rr FROM events), m AS (SELECT event_type, quantile_cont(rr, 0.5) FILTER (rr BETWEEN 60 AND 7200) AS med FROM d GROUP BY 1) SELECT event_type, round(avg(CASE WHEN rr < 0.75 * med THEN 1.0 ELSE 0 END), 6) AS share FROM d JOIN m USING (event_type) WHERE rr IS NOT NULL GROUP BY 1")
def implausible_fraction(spark, sf):
    w = Window.partitionBy("event_type").orderBy("us", "event_id")
    d = events(spark, sf).select("event_type", ((F.col("us") - F.lag("us").over(w)) / 1e6).alias("rr")).where("rr is not null")
    m = d.groupBy("event_type").agg(F.percentile(F.when(F.col("rr").between(60, 7200), F.col("rr")), F.lit(0.5)).alias("med"))
    return d.join(m, "event_type").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("rr") < 0.75 * F.col("med"), 1.0).otherwise(0.0)), 6).alias("share"))


@query("relative_gain", f"WITH {FRAMES}, m AS (SELECT frame, quantile_cont(rms, 0.5) AS c FROM frames GROUP BY 1 HAVING count(*) = 5) SELECT signal, round(quantile_cont(rms / c, 0.5), 6) AS gain, count(*) AS n FROM frames JOIN m USING (frame) GROUP BY 1")
def relative_gain(spark, sf):
    """Each frame normalised by its own median over channels, then the channel's median."""
    f = frames(spark, sf)
    m = f.groupBy("frame").agg(F.percentile("rms", F.lit(0.5)).alias("c"), F.count("*").alias("k")).where("k = 5")
    return f.join(m, "frame").groupBy("signal").agg(F.round(F.percentile(F.col("rms") / F.col("c"), F.lit(0.5)), 6).alias("gain"), F.count("*").alias("n"))


@query("dose_response", "WITH v AS (SELECT p_brand AS unit, p_size // 10 AS level, quantile_cont(p_retailprice, 0.5) AS a, avg(p_retailprice) AS b FROM part GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY unit ORDER BY a) AS ra, rank() OVER (PARTITION BY unit ORDER BY b) AS rb, max(greatest(a, b)) OVER (PARTITION BY unit) - min(least(a, b)) OVER (PARTITION BY unit) AS span FROM v) SELECT unit, count(*) AS levels, bool_or(ra <> rb) AS rank_changed, bool_or(abs(a - b) > 0.1 * span) AS moved FROM r GROUP BY 1")
def dose_response(spark, sf):
    """Two summaries per level disagree if their rank order differs or a level moves by over a tenth of the range."""
    v = table(spark, sf, "part").groupBy(F.col("p_brand").alias("unit"), F.expr("p_size div 10").alias("level")).agg(F.percentile("p_retailprice", F.lit(0.5)).alias("a"), F.avg("p_retailprice").alias("b"))
    unit = Window.partitionBy("unit")
    span = F.max(F.greatest("a", "b")).over(unit) - F.min(F.least("a", "b")).over(unit)
    r = v.select("unit", F.rank().over(unit.orderBy("a")).alias("ra"), F.rank().over(unit.orderBy("b")).alias("rb"), span.alias("span"), "a", "b")
    return r.groupBy("unit").agg(F.count("*").alias("levels"), F.bool_or(F.col("ra") != F.col("rb")).alias("rank_changed"), F.bool_or(F.abs(F.col("a") - F.col("b")) > 0.1 * F.col("span")).alias("moved"))


@query("max_of_sums", "WITH s AS (SELECT o_custkey, o_orderkey, sum(CASE WHEN l_quantity > 1 THEN l_quantity END) AS total, bool_or(l_quantity <= 1) AS unknown FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT o_custkey, CASE WHEN bool_or(unknown) THEN NULL ELSE max(total) END AS settling FROM s GROUP BY 1")
def max_of_sums(spark, sf):
    """The largest sum of stages over outputs; one unknown stage makes it unknown."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey"))
    unknown = F.col("l_quantity") <= 1
    s = rows.groupBy("o_custkey", "o_orderkey").agg(F.sum(F.when(~unknown, F.col("l_quantity"))).alias("total"), F.bool_or(unknown).alias("unknown"))
    return s.groupBy("o_custkey").agg(F.when(~F.bool_or("unknown"), F.max("total")).alias("settling"))


CURVE = "cu AS (SELECT l_suppkey AS seed, l_discount AS amp, avg(l_quantity) > 25.5 AS changed FROM lineitem GROUP BY 1, 2), x AS (SELECT seed, min(amp) FILTER (changed) AS hi, max(amp) FILTER (NOT changed) AS top FROM cu GROUP BY 1), y AS (SELECT x.seed, x.hi, (SELECT max(c.amp) FROM cu c WHERE c.seed = x.seed AND c.amp < x.hi) AS lo FROM x)"


def curves(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("seed"), F.col("l_discount").alias("amp")).agg((F.avg("l_quantity") > 25.5).alias("changed"))
    return g.withColumn("prev", F.lag("amp").over(Window.partitionBy("seed").orderBy("amp")))


@query("censored_crossing", f"WITH {CURVE} SELECT seed, lo, hi, CASE WHEN hi IS NULL THEN 'above' WHEN lo IS NULL THEN 'below' ELSE 'inside' END AS side FROM y")
def censored_crossing(spark, sf):
    """The lowest amplitude that changed and the point before it; censored where the crossing lies outside."""
    first = curves(spark, sf).groupBy("seed").agg(F.min(F.when(F.col("changed"), F.struct("amp", "prev"))).alias("m"))
    return first.select("seed", F.col("m.prev").alias("lo"), F.col("m.amp").alias("hi"), F.when(F.col("m").isNull(), "above").when(F.col("m.prev").isNull(), "below").otherwise("inside").alias("side"))


@query("tolerance_table", f"WITH {CURVE}, k AS (SELECT *, row_number() OVER (ORDER BY hi NULLS LAST, seed) AS i, count(*) OVER () AS n FROM y) SELECT n, greatest(1, ceil(0.1 * n))::INTEGER AS k, max(hi) FILTER (i = greatest(1, ceil(0.1 * n))) AS tolerance, count(*) FILTER (hi IS NULL) AS censored_above, count(*) FILTER (lo IS NULL AND hi IS NOT NULL) AS censored_below FROM k GROUP BY n")
def tolerance_table(spark, sf):
    """The k-th most sensitive bound over seeds, k a tenth of them; by two aggregates and no global sort."""
    first = curves(spark, sf).groupBy("seed").agg(F.min(F.when(F.col("changed"), F.struct("amp", "prev"))).alias("m")).select("seed", F.col("m.amp").alias("hi"), F.col("m.prev").alias("lo"))
    n = first.agg(F.count("*")).scalar()
    k = F.greatest(F.lit(1), F.ceil(0.1 * n)).cast("int")
    by = first.groupBy("hi").agg(F.count("*").alias("c"), F.count_if(F.col("lo").isNull()).alias("b"))
    upto = by.withColumn("upto", F.sum("c").over(Window.orderBy(F.col("hi").asc_nulls_last())))
    counts = upto.agg(F.sum("c").alias("n"), F.min(F.when(F.col("upto") >= k, F.col("hi"))).alias("tolerance"), F.coalesce(F.sum(F.when(F.col("hi").isNull(), F.col("c"))), F.lit(0)).alias("censored_above"), F.coalesce(F.sum(F.when(F.col("hi").isNotNull(), F.col("b"))), F.lit(0)).alias("censored_below"))
    return counts.select("n", F.greatest(F.lit(1), F.ceil(0.1 * F.col("n"))).cast("int").alias("k"), "tolerance", "censored_above", "censored_below")


@query("option1_threshold", f"WITH {SCORED}, w AS (SELECT frame // 24 AS d, signal, max(z) AS top, max(z) FILTER (z < 2.0) AS base FROM scored WHERE z IS NOT NULL GROUP BY 1, 2), v AS (SELECT signal, min(top) FILTER (top > base) AS visible, max(base) AS floor FROM w GROUP BY 1) SELECT signal, round(greatest(coalesce(floor, 0), coalesce(visible, 0)), 6) AS threshold FROM v")
def option1_threshold(spark, sf):
    z = scored(spark, sf).where("z is not null")
    w = z.groupBy("signal", F.expr("frame div 24").alias("d")).agg(F.max("z").alias("top"), F.max(F.when(F.col("z") < 2.0, F.col("z"))).alias("base"))
    v = w.groupBy("signal").agg(F.min(F.when(F.col("top") > F.col("base"), F.col("top"))).alias("visible"), F.max("base").alias("floor"))
    return v.select("signal", F.round(F.greatest(F.coalesce("floor", F.lit(0.0)), F.coalesce("visible", F.lit(0.0))), 6).alias("threshold"))


@query("floor_percentile", f"WITH {SCORED} SELECT CASE WHEN signal IN ('click', 'view') THEN 'fast' ELSE 'slow' END AS family, round(quantile_cont(z, 0.99), 2) AS p99, round(quantile_cont(z, 0.9), 2) AS p90, count(z) AS n FROM scored GROUP BY 1")
def floor_percentile(spark, sf):
    family = F.when(F.col("signal").isin("click", "view"), "fast").otherwise("slow").alias("family")
    return scored(spark, sf).groupBy(family).agg(F.round(F.percentile("z", F.lit(0.99)), 2).alias("p99"), F.round(F.percentile("z", F.lit(0.9)), 2).alias("p90"), F.count("z").alias("n"))


@query("acceptance_rows", f"WITH {LAB}, r1 AS (SELECT lang, count(*) FILTER (p >= 0.25)::DOUBLE / count(*) AS v FROM lab WHERE y = 1 GROUP BY 1), r2 AS (SELECT avg(y) AS v FROM lab), r6 AS (SELECT source, count(*) FILTER (p >= 0.25 AND y = 1)::DOUBLE / nullif(count(*) FILTER (y = 1), 0) AS v FROM lab GROUP BY 1) SELECT 'recall' AS name, round(min(v), 6) AS value, CASE WHEN count(v) < count(*) THEN 'not computable' WHEN min(v) >= 0.98 THEN 'pass' ELSE 'fail' END AS status FROM r1 UNION ALL SELECT 'balance', round(v, 6), CASE WHEN v >= 0.05 THEN 'pass' ELSE 'fail' END FROM r2 UNION ALL SELECT 'groups', round(min(v), 6), CASE WHEN count(v) < count(*) THEN 'not computable' WHEN min(v) >= 0.5 THEN 'pass' ELSE 'fail' END FROM r6")
def acceptance_rows(spark, sf):
    """Rows pass, fail, or cannot be computed; a missing value is never a pass."""
    lab = labelled(spark, sf)
    found, y = (F.col("p") >= 0.25) & (F.col("y") == 1), F.col("y") == 1
    by = lambda c: lab.groupBy(c).agg(ratio(F.count_if(found), F.count_if(y)).alias("v"))
    least = lambda df, name, bar: df.agg(F.min("v").alias("value"), (F.count("v") < F.count("*")).alias("gap")).select(F.lit(name).alias("name"), F.round("value", 6).alias("value"), E.status(F.col("value") >= bar, F.col("gap")).alias("status"))
    balance = lab.agg(F.avg("y").alias("v")).select(F.lit("balance").alias("name"), F.round("v", 6).alias("value"), E.status(F.col("v") >= 0.05).alias("status"))
    return least(by("lang"), "recall", 0.98).union(balance).union(least(by("source"), "groups", 0.5))


@query("nan_audit", f"WITH {FRAMES}, g AS (SELECT signal, unnest(generate_series((SELECT min(frame) FROM frames), (SELECT max(frame) FROM frames))) AS frame FROM (SELECT DISTINCT signal FROM frames)) SELECT g.signal, count(*) AS n, count(*) FILTER (f.rms IS NULL) AS masked, count(*) FILTER (f.rms = 0) AS zeros FROM g LEFT JOIN frames f USING (signal, frame) GROUP BY 1")
def nan_audit(spark, sf):
    """Masked values are missing, never zero."""
    f = frames(spark, sf)
    length = f.agg(F.max("frame") - F.min("frame") + 1).scalar()
    per = f.groupBy("signal").agg(F.count("rms").alias("k"), F.count_if(F.col("rms") == 0).alias("zeros"))
    return per.select("signal", length.alias("n"), (length - F.col("k")).alias("masked"), "zeros")
