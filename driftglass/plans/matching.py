"""Matching: overlap, nearest, as-of, pairing and membership joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.functions.robust import correlation, ratio
from driftglass.operators import runs as R
from driftglass.operators.candidates import candidates, cores
from driftglass.operators.joins import as_of, nearest, overlap_join
from driftglass.operators.matching import greedy_train_match
from driftglass.sources.shared import shared_folder, staged

from .base import FRAMES, SCORED, events, frames, query, scored, table
from .detection import CORES, DRIVER, ENTER, HYST, LEAVE

MARKS = "mk AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS a, epoch_us(ts) // 3600000000 + 2 AS b FROM events WHERE event_type = 'purchase' AND value > 100)"
MARKED = f"{MARKS}, mn AS (SELECT *, CASE WHEN a <= max(b) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM mk), mr AS (SELECT *, sum(new) OVER (ORDER BY a) AS run FROM mn), marks AS (SELECT min(a) AS a, max(b) AS b FROM mr GROUP BY run)"


def marks(spark, sf):
    """Merged two-hour marks after large purchases."""
    start = F.expr("us div 3600000000")
    raw = events(spark, sf).where("event_type = 'purchase' and value > 100").select(start.alias("start"), (start + 2).alias("stop")).distinct()
    return R.merge_intervals(raw, [], block=R.BLOCK).select(F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))


def hyst(spark, sf):
    z = scored(spark, sf)
    return R.hysteresis(z, ["signal"], "frame", F.col("z") > ENTER, F.col("z") > LEAVE)


def of_type(spark, sf, kind):
    """(user_id, t, value, event_id) of one type of event; t in seconds."""
    return events(spark, sf).where(F.col("event_type") == kind).select("user_id", (F.col("us") / 1e6).alias("t"), "value", "event_id")


T = "epoch_us(ts) / 1000000.0::DOUBLE"
SIGNUPS = f"su AS (SELECT user_id, {T} AS t, value, event_id FROM events WHERE event_type = 'signup')"
PURCHASES = f"pu AS (SELECT user_id, {T} AS t, value, event_id FROM events WHERE event_type = 'purchase')"


@query("interval_semi_join", f"WITH {HYST}, {MARKED} SELECT signal, start, stop FROM hyst WHERE EXISTS (SELECT 1 FROM marks WHERE least(b, stop) > greatest(a, start))")
def interval_semi_join(spark, sf):
    runs = hyst(spark, sf).withColumn("id", F.concat_ws("|", "signal", "start"))
    return overlap_join(runs, marks(spark, sf), [], 64, "left_semi").drop("id")


@query("covered_fraction", f"WITH {HYST}, {MARKED} SELECT h.signal, h.start, h.stop, round(sum(greatest(0, least(b, h.stop) - greatest(a, h.start)))::DOUBLE / any_value(h.stop - h.start), 6) AS covered FROM hyst h, marks GROUP BY 1, 2, 3 HAVING covered > 0")
def covered_fraction(spark, sf):
    pairs = overlap_join(hyst(spark, sf), marks(spark, sf), [], 64)
    length = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    return pairs.groupBy("signal", "start", "stop").agg(F.sum(length).alias("n")).select("signal", "start", "stop", F.round(ratio(F.col("n"), F.col("stop") - F.col("start")), 6).alias("covered"))


@query("judge_cores", f"WITH {CORES}, {MARKED}, o AS (SELECT c.c_start, c.start, c.stop, coalesce(sum(CASE WHEN a IS NOT NULL THEN least(b, c.stop) - greatest(a, c.start) END), 0)::DOUBLE / any_value(c.stop - c.start) AS f FROM cores c LEFT JOIN marks ON least(b, c.stop) > greatest(a, c.start) GROUP BY 1, 2, 3) SELECT c_start AS candidate, start, stop, round(f, 6) AS covered, CASE WHEN f >= 0.5 THEN 'motion' WHEN f > 0 THEN 'unjudged' ELSE 'negative' END AS judgement FROM o")
def judge_cores(spark, sf):
    z = staged(scored(spark, sf), shared_folder(spark, "scored"), "frames")
    found = cores(z, candidates(z, DRIVER), ENTER).select("candidate", "start", "stop")
    length = F.least("stop", "r_stop") - F.greatest("start", "r_start")
    hit = overlap_join(found, marks(spark, sf), [], 64).groupBy("candidate", "start", "stop").agg(F.sum(length).alias("n"))
    f = F.coalesce(ratio(F.col("n"), F.col("stop") - F.col("start")), F.lit(0.0))
    judged = found.join(hit, ["candidate", "start", "stop"], "left").withColumn("covered", f)
    kind = F.when(F.col("covered") >= 0.5, "motion").when(F.col("covered") > 0, "unjudged").otherwise("negative")
    return judged.select("candidate", "start", "stop", F.round("covered", 6).alias("covered"), kind.alias("judgement"))


@query("nearest_event", f"WITH {SIGNUPS}, {PURCHASES} SELECT pu.event_id, round(min(abs(pu.t - su.t)), 3) AS distance FROM pu LEFT JOIN su USING (user_id) GROUP BY 1")
def nearest_event(spark, sf):
    found = nearest(of_type(spark, sf, "purchase"), of_type(spark, sf, "signup"), ["user_id"], 86_400.0)
    return found.select("event_id", F.round("distance", 3).alias("distance"))


PAIRS = f"{SIGNUPS}, {PURCHASES}, c AS (SELECT pu.event_id, pu.value AS p_value, su.event_id AS s_id, su.value AS s_value, su.value > 30 AS usable, count(*) OVER (PARTITION BY pu.event_id) AS n, count(*) FILTER (su.value > 30) OVER (PARTITION BY pu.event_id) AS u FROM pu JOIN su ON pu.user_id = su.user_id AND pu.t - su.t BETWEEN 300 AND 604800), m AS (SELECT event_id, any_value(p_value) AS p_value, CASE WHEN any_value(n) = 1 THEN min(s_id) WHEN any_value(u) = 1 THEN min(s_id) FILTER (usable) END AS partner FROM c GROUP BY 1)"


def paired(spark, sf):
    """Purchases with a signup of the same user five minutes to a week before: the only one, or the only usable one."""
    p = of_type(spark, sf, "purchase").select("event_id", F.col("t").alias("stop"), F.col("value").alias("p_value"), "user_id")
    lo = p.withColumn("start", F.col("stop") - 604_800.0).withColumn("stop", F.col("stop") - 299.0)
    s = of_type(spark, sf, "signup").select("user_id", F.col("t").alias("r_start"), (F.col("t") + 1).alias("r_stop"), F.col("event_id").alias("s_id"), F.col("value").alias("s_value"))
    gap = F.col("stop") + 299.0 - F.col("r_start")
    near = overlap_join(lo.withColumn("start", F.col("start") - 1.0), s, ["user_id"], 604_800.0).where((gap >= 300) & (gap <= 604_800))
    usable = F.col("s_value") > 30
    grouped = near.groupBy("event_id").agg(F.first("p_value").alias("p_value"), F.count("*").alias("n"), F.count_if(usable).alias("u"), F.min("s_id").alias("any_"), F.min(F.when(usable, F.col("s_id"))).alias("good"))
    return grouped.select("event_id", "p_value", F.when(F.col("n") == 1, F.col("any_")).when(F.col("u") == 1, F.col("good")).alias("partner"))


@query("session_pairing", f"WITH {PAIRS} SELECT event_id, partner, CASE WHEN partner IS NULL THEN 'ambiguous' ELSE 'matched' END AS status FROM m")
def session_pairing(spark, sf):
    return paired(spark, sf).select("event_id", "partner", F.when(F.col("partner").isNull(), "ambiguous").otherwise("matched").alias("status"))


@query("exclusion_propagate", f"WITH {PAIRS}, r AS (SELECT event_id, 'short' AS reason, 0 AS prio FROM events WHERE event_type IN ('purchase', 'signup') AND value < 20 UNION ALL SELECT partner, 'partner of ' || event_id, 1 FROM m WHERE partner IS NOT NULL AND p_value < 20), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY prio, reason) AS i FROM r) SELECT event_id, reason FROM k WHERE i = 1")
def exclusion_propagate(spark, sf):
    """An exclusion passes to the partner; a row's own reason comes first."""
    own = events(spark, sf).where("event_type in ('purchase', 'signup') and value < 20").select("event_id", F.lit("short").alias("reason"), F.lit(0).alias("prio"))
    passed = paired(spark, sf).where("partner is not null and p_value < 20").select(F.col("partner").alias("event_id"), F.concat(F.lit("partner of "), "event_id").alias("reason"), F.lit(1).alias("prio"))
    return own.unionByName(passed).groupBy("event_id").agg(F.min(F.struct("prio", "reason")).alias("r")).select("event_id", "r.reason")


@query("coincidence_veto", f"WITH {SIGNUPS}, cl AS (SELECT {T} AS t, value FROM events WHERE event_type = 'click') SELECT su.event_id, coalesce(max(cl.value) > 90, false) AS vetoed FROM su LEFT JOIN cl ON cl.t >= su.t - 60 AND cl.t <= su.t + 60 GROUP BY 1")
def coincidence_veto(spark, sf):
    """Whether another source exceeds a level within a minute of the event."""
    s = of_type(spark, sf, "signup").select("event_id", (F.col("t") - 60).alias("start"), (F.col("t") + 60.000001).alias("stop"))
    c = of_type(spark, sf, "click").where("value > 90").select(F.col("t").alias("r_start"), (F.col("t") + 0.000001).alias("r_stop"))
    hit = overlap_join(s, c, [], 3600.0).select("event_id").distinct().withColumn("vetoed", F.lit(True))
    return s.select("event_id").join(hit, "event_id", "left").fillna(False, ["vetoed"])


@query("timing_match", f"WITH {SIGNUPS}, {PURCHASES}, a AS (SELECT pu.event_id, min(abs(pu.t - su.t)) AS d FROM pu LEFT JOIN su USING (user_id) GROUP BY 1), b AS (SELECT su.event_id, min(abs(pu.t - su.t)) AS d FROM su LEFT JOIN pu USING (user_id) GROUP BY 1) SELECT 'purchase' AS side, count(*) AS n, round(avg(CASE WHEN d <= 86400 THEN 1.0 ELSE 0 END), 6) AS rate FROM a UNION ALL SELECT 'signup', count(*), round(avg(CASE WHEN d <= 86400 THEN 1.0 ELSE 0 END), 6) FROM b")
def timing_match(spark, sf):
    a, b = of_type(spark, sf, "purchase"), of_type(spark, sf, "signup")
    within = F.avg(F.when(F.col("distance") <= 86_400, 1.0).otherwise(0.0))
    rate = lambda x, y, name: nearest(x, y, ["user_id"], 86_400.0).agg(F.count("*").alias("n"), F.round(within, 6).alias("rate")).select(F.lit(name).alias("side"), "n", "rate")
    return rate(a, b, "purchase").unionByName(rate(b, a, "signup"))


@query("points_in_windows", f"WITH {SCORED}, w AS (SELECT DISTINCT frame FROM scored WHERE signal = 'click' AND z > 1.0) SELECT event_type, count(*) AS n FROM events WHERE epoch_us(ts) // 3600000000 IN (SELECT frame FROM w) GROUP BY 1")
def points_in_windows(spark, sf):
    windows = scored(spark, sf).where("signal = 'click' and z > 1.0").select("frame").distinct()
    e = events(spark, sf).select("event_type", F.expr("us div 3600000000").alias("frame"))
    return e.join(windows, "frame", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))


@query("paired_predictions", "WITH a AS (SELECT doc_id, quality AS p FROM labels), b AS (SELECT doc_id, source, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p FROM documents) SELECT source, count(*) AS n, count(*) FILTER (a.p <> b.p) AS differ FROM a JOIN b USING (doc_id) GROUP BY 1")
def paired_predictions(spark, sf):
    a = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("p_a"))
    b = table(spark, sf, "documents").select("doc_id", "source", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("p_b"))
    return a.join(b, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("p_a") != F.col("p_b")).alias("differ"))


@query("loao_folds", "WITH l AS (SELECT source, quality FROM labels JOIN documents USING (doc_id)), g AS (SELECT source, count(*) AS n, sum(quality)::BIGINT AS pos FROM l GROUP BY 1) SELECT t.source AS target, t.n AS test_rows, t.pos AS test_pos, sum(o.n)::BIGINT AS train_rows, sum(o.pos)::BIGINT AS train_pos FROM g t JOIN g o ON o.source <> t.source GROUP BY 1, 2, 3")
def loao_folds(spark, sf):
    """Leave one group out: the training side is the total less the group's own counts."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    by = rows.groupBy("source").agg(F.count("*").alias("test_rows"), F.sum("quality").alias("test_pos"))
    total = rows.agg(F.count("*").alias("n"), F.sum("quality").alias("p"))
    return by.select(F.col("source").alias("target"), "test_rows", "test_pos", (total.select("n").scalar() - F.col("test_rows")).alias("train_rows"), (total.select("p").scalar() - F.col("test_pos")).alias("train_pos"))


@query("leak_check", "WITH h AS (SELECT sha256(text) AS k, source FROM documents), s AS (SELECT k FROM h GROUP BY k HAVING count(DISTINCT source) > 1) SELECT source, count(DISTINCT k) AS leaked FROM h WHERE k IN (SELECT k FROM s) GROUP BY 1")
def leak_check(spark, sf):
    """Contents of a group that another group holds too."""
    h = table(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("k"), "source").distinct()
    shared = h.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    return h.join(shared, "k", "left_semi").groupBy("source").agg(F.count("*").alias("leaked"))


@query("score_marks", f"WITH {HYST}, {MARKED} SELECT a AS start, b AS stop, count(signal) AS n_found, count(signal) > 0 AS caught FROM marks LEFT JOIN hyst ON start < b AND stop > a GROUP BY 1, 2")
def score_marks(spark, sf):
    m = marks(spark, sf).select(F.col("r_start").alias("start"), F.col("r_stop").alias("stop"))
    found = hyst(spark, sf).select(F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    n = overlap_join(m, found, [], 64).groupBy("start", "stop").agg(F.count("*").alias("n_found"))
    return m.join(n, ["start", "stop"], "left").fillna(0, ["n_found"]).withColumn("caught", F.col("n_found") > 0)


CORRS = f"{FRAMES}, cp AS (SELECT a.signal AS a, b.signal AS b, corr(a.rms, b.rms) AS r, count(*) AS n FROM frames a JOIN frames b ON a.frame = b.frame AND a.signal < b.signal GROUP BY 1, 2), cboth AS (SELECT a AS signal, b AS other, r, n FROM cp UNION ALL SELECT b, a, r, n FROM cp)"


@query("contact_quality", f"WITH {CORRS}, k AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY abs(r) DESC, other) AS i FROM cboth) SELECT signal, other, round(r, 6) AS r, n FROM k WHERE i = 1")
def contact_quality(spark, sf):
    """For each channel the other with the largest absolute correlation over common frames."""
    f = frames(spark, sf)
    b = f.select("frame", F.col("signal").alias("b"), F.col("rms").alias("y"))
    pairs = f.join(b, "frame").where("signal < b").groupBy("signal", "b").agg(correlation(F.col("rms"), F.col("y")).alias("r"), F.count("*").alias("n"))
    both = pairs.select("signal", F.col("b").alias("other"), "r", "n").union(pairs.select("b", "signal", "r", "n"))
    best = both.groupBy("signal").agg(F.min(F.struct((-F.abs("r")).alias("k"), "other", "r", "n")).alias("m"))
    return best.select("signal", "m.other", F.round("m.r", 6).alias("r"), "m.n")


@query("simultaneity", f"WITH {FRAMES}, m AS (SELECT signal, quantile_cont(rms, 0.5) AS c FROM frames GROUP BY 1), x AS (SELECT frame, count(*) FILTER (rms > 1.1 * c) AS k, quantile_cont(rms / c, 0.5) AS level FROM frames JOIN m USING (signal) GROUP BY 1) SELECT frame, k, round(level, 6) AS level FROM x WHERE k >= 3")
def simultaneity(spark, sf):
    """Frames where at least three channels are well above their own median."""
    f = frames(spark, sf)
    m = f.groupBy("signal").agg(F.percentile("rms", F.lit(0.5)).alias("c"))
    x = f.join(m, "signal").groupBy("frame").agg(F.count_if(F.col("rms") > 1.1 * F.col("c")).alias("k"), F.round(F.percentile(F.col("rms") / F.col("c"), F.lit(0.5)), 6).alias("level"))
    return x.where("k >= 3").select("frame", "k", "level")


@query("routed_spans", "WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'reject' WHEN c_acctbal < 500 THEN 'clip' ELSE 'keep' END AS route FROM customer) SELECT o_orderkey, route FROM orders LEFT JOIN d ON o_custkey = c_custkey WHERE route IN ('reject', 'clip')")
def routed_spans(spark, sf):
    """Extents with a masking route; an extent without a decision is an error, not a silent pass."""
    bal = F.col("c_acctbal")
    d = table(spark, sf, "customer").select("c_custkey", F.when(bal < 0, "reject").when(bal < 500, "clip").otherwise("keep").alias("route"))
    joined = table(spark, sf, "orders").join(d, F.col("o_custkey") == F.col("c_custkey"), "left")
    told = F.when(F.col("c_custkey").isNull(), F.raise_error(F.lit("an extent has no decision"))).otherwise(F.col("route"))
    return joined.select("o_orderkey", told.alias("route")).where(F.col("route").isin("reject", "clip"))


@query("applicable_models", "WITH m AS (SELECT s_suppkey AS model, s_nationkey AS nk, CASE WHEN s_suppkey % 10 = 0 THEN 'pooled' ELSE 'own' END AS mode FROM supplier), r AS (SELECT n_nationkey, count(*) AS n, count(DISTINCT mode) AS modes FROM nation JOIN m ON mode = 'pooled' OR nk = n_nationkey GROUP BY 1) SELECT n_nationkey, n, modes > 1 AS mixed FROM r")
def applicable_models(spark, sf):
    """Pooled models apply to every key, others to their own; the two sorts are joined apart, no theta join."""
    m = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.when(F.col("s_suppkey") % 10 == 0, "pooled").otherwise("own").alias("mode"))
    own = m.where("mode = 'own'").groupBy("n_nationkey").agg(F.count("*").alias("own"))
    pooled = m.where("mode = 'pooled'").agg(F.count("*").alias("n")).scalar()
    n = table(spark, sf, "nation").join(own, "n_nationkey", "left").select("n_nationkey", F.coalesce("own", F.lit(0)).alias("own"), pooled.alias("pooled"))
    return n.where("own + pooled > 0").select("n_nationkey", (F.col("own") + F.col("pooled")).alias("n"), ((F.col("own") > 0) & (F.col("pooled") > 0)).alias("mixed"))


@query("boundary_diff", "SELECT l_returnflag, count(*) AS n, sum(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - CASE WHEN l_returnflag = 'R' THEN 30 ELSE 60 END)::BIGINT AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def boundary_diff(spark, sf):
    """The boundary that applies depends on the modality; the signed difference to it."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) - F.when(F.col("l_returnflag") == "R", 30).otherwise(60)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(days).alias("days"))


@query("span_rule", f"WITH {SIGNUPS}, v AS (SELECT event_id, user_id, {T} AS t FROM events WHERE event_type = 'view'), d AS (SELECT v.event_id, v.user_id, v.t, coalesce(min(CASE WHEN v.t < su.t THEN su.t - v.t WHEN v.t > su.t + 3600 THEN v.t - su.t - 3600 ELSE 0 END), 1e18) AS d FROM v LEFT JOIN su USING (user_id) GROUP BY 1, 2, 3), w AS (SELECT *, lag(t) OVER o AS pt, lag(d) OVER o AS pd, lead(t) OVER o AS nt, lead(d) OVER o AS nd FROM d WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id, d < 7200 OR (d <= 86400 AND ((t - pt < 7200 AND pd <= 86400) OR (nt - t < 7200 AND nd <= 86400))) IS TRUE AS dropped FROM w WHERE d < 7200 OR ((d <= 86400 AND ((t - pt < 7200 AND pd <= 86400) OR (nt - t < 7200 AND nd <= 86400))) IS TRUE)")
def span_rule(spark, sf):
    """Drops points near a span, and both of two consecutive points that are close together within the zone."""
    spans = of_type(spark, sf, "signup")
    v = of_type(spark, sf, "view").select("event_id", "user_id", "t")
    back = as_of(v, spans, ["user_id"], 86_400.0).withColumnRenamed("e_t", "before")
    both = as_of(back, spans, ["user_id"], 86_400.0, forward=True)
    after = F.when(F.col("before").isNotNull(), F.greatest(F.col("t") - F.col("before") - 3600, F.lit(0.0)))
    gap = F.least(after, F.col("e_t") - F.col("t"))
    d = both.withColumn("d", F.coalesce(gap, F.lit(1e18)))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    near = lambda side: (F.abs(side("t").over(w) - F.col("t")) < 7200) & (side("d").over(w) <= 86_400)
    close = (F.col("d") <= 86_400) & (F.coalesce(near(F.lag), F.lit(False)) | F.coalesce(near(F.lead), F.lit(False)))
    return d.withColumn("dropped", (F.col("d") < 7200) | close).where("dropped").select("event_id", "dropped")


@query("next_span_asof", f"WITH {SIGNUPS}, m AS (SELECT quantile_cont(value, 0.5) AS c FROM events WHERE event_type = 'click'), k AS (SELECT event_id, user_id, {T} AS t FROM events, m WHERE event_type = 'click' AND value > 1.5 * c) SELECT k.event_id, round(min(su.t) - any_value(k.t), 3) AS wait FROM k JOIN su ON su.user_id = k.user_id AND su.t >= k.t AND su.t - k.t <= 86400 GROUP BY 1")
def next_span_asof(spark, sf):
    """The next span after each strong point, if it comes within a day."""
    k = of_type(spark, sf, "click")
    level = k.agg(F.percentile("value", F.lit(0.5))).scalar()
    found = as_of(k.where(F.col("value") > 1.5 * level), of_type(spark, sf, "signup"), ["user_id"], 86_400.0, forward=True)
    return found.where(F.col("e_t") - F.col("t") <= 86_400).select("event_id", F.round(F.col("e_t") - F.col("t"), 3).alias("wait"))


@query("phase_asof", f"WITH {SIGNUPS}, {PURCHASES}, b AS (SELECT pu.event_id, pu.t, max(su.t) FILTER (su.t <= pu.t) AS a, min(su.t) FILTER (su.t > pu.t) AS z FROM pu JOIN su USING (user_id) GROUP BY 1, 2) SELECT event_id, round((t - a) / (z - a), 6) AS phase FROM b WHERE a IS NOT NULL AND z IS NOT NULL")
def phase_asof(spark, sf):
    s = of_type(spark, sf, "signup")
    back = as_of(of_type(spark, sf, "purchase"), s, ["user_id"], 86_400.0).withColumnRenamed("e_t", "a")
    both = as_of(back, s, ["user_id"], 86_400.0, forward=True, strict=True)
    return both.where("a is not null and e_t is not null").select("event_id", F.round((F.col("t") - F.col("a")) / (F.col("e_t") - F.col("a")), 6).alias("phase"))


@query("tainted_groups", "SELECT p_brand, count(*) AS n, bool_and(p_retailprice < 1890) AS all_pass, count(*) FILTER (p_retailprice >= 1890) AS failed FROM part GROUP BY 1")
def tainted_groups(spark, sf):
    """A derived signal passes only if every member does."""
    ok = F.col("p_retailprice") < 1890
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.bool_and(ok).alias("all_pass"), F.count_if(~ok).alias("failed"))


@query("group_key", "SELECT lang || ':' || upper(regexp_extract(source, '([a-z]+)', 1)) || '-' || regexp_extract(source, '([0-9]+)', 1) AS key, count(*) AS n FROM documents GROUP BY 1")
def group_key(spark, sf):
    key = F.concat("lang", F.lit(":"), F.upper(F.regexp_extract("source", "([a-z]+)", 1)), F.lit("-"), F.regexp_extract("source", "([0-9]+)", 1))
    return table(spark, sf, "documents").groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("extents_all", f"WITH {HYST}, ev AS (SELECT DISTINCT frame AS id FROM scored WHERE z > 2.0), own AS (SELECT e.id, h.signal, min(h.start) AS start, max(h.stop) AS stop FROM ev e JOIN hyst h ON h.start < e.id + 1 AND h.stop > e.id GROUP BY 1, 2), fall AS (SELECT id, min(start) AS start, max(stop) AS stop FROM own GROUP BY 1), sig AS (SELECT DISTINCT signal FROM frames), seen AS (SELECT DISTINCT signal, frame FROM scored WHERE z IS NOT NULL) SELECT ev.id, sig.signal, CASE WHEN own.start IS NOT NULL THEN 'own' WHEN seen.frame IS NULL THEN 'not assessable' WHEN fall.start IS NOT NULL THEN 'cross' ELSE 'none' END AS status, coalesce(own.start, CASE WHEN seen.frame IS NOT NULL THEN fall.start END) AS start, coalesce(own.stop, CASE WHEN seen.frame IS NOT NULL THEN fall.stop END) AS stop FROM ev CROSS JOIN sig LEFT JOIN own ON own.id = ev.id AND own.signal = sig.signal LEFT JOIN fall ON fall.id = ev.id LEFT JOIN seen ON seen.signal = sig.signal AND seen.frame = ev.id")
def extents_all(spark, sf):
    """Every event and signal: its own extent, else the cross-signal one, else none; or not assessable."""
    z = scored(spark, sf)
    ev = z.where(F.col("z") > ENTER).select(F.col("frame").alias("id")).distinct().select("id", F.col("id").alias("start"), (F.col("id") + 1).alias("stop"))
    found = hyst(spark, sf).select("signal", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    own = overlap_join(ev, found, [], 64).groupBy("id", "signal").agg(F.min("r_start").alias("a"), F.max("r_stop").alias("b"))
    hull = own.groupBy("id").agg(F.min("a").alias("ha"), F.max("b").alias("hb"))
    signals = z.select("signal").distinct().agg(F.sort_array(F.collect_list("signal"))).scalar()
    grid = ev.select("id", F.explode(signals).alias("signal"))
    seen = z.where("z is not null").select("signal", F.col("frame").alias("id"), F.lit(True).alias("seen"))
    all_ = grid.join(own, ["id", "signal"], "left").join(hull, "id", "left").join(seen, ["id", "signal"], "left")
    status = F.when(F.col("a").isNotNull(), "own").when(F.col("seen").isNull(), "not assessable").when(F.col("ha").isNotNull(), "cross").otherwise("none")
    return all_.select("id", "signal", status.alias("status"), F.coalesce("a", F.when(F.col("seen"), F.col("ha"))).alias("start"), F.coalesce("b", F.when(F.col("seen"), F.col("hb"))).alias("stop"))


GREEDY = f"""WITH RECURSIVE {SIGNUPS}, pu AS (SELECT user_id, {T} AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS k FROM events WHERE event_type = 'purchase'),
ps AS (SELECT user_id, list({{'t': t, 'k': k}}) AS ps FROM pu GROUP BY 1), s AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM su),
f AS (SELECT user_id, 0::BIGINT AS i, []::BIGINT[] AS used, 0.0::DOUBLE AS shift FROM (SELECT DISTINCT user_id FROM s)
UNION ALL SELECT user_id, j, CASE WHEN b IS NULL THEN used ELSE list_append(used, b.k) END, greatest(shift, coalesce(b.d, 0)) FROM (SELECT f.user_id, s.i AS j, used, shift,
list_min(list_transform(list_filter(ps, lambda x: abs(x.t - s.t) <= 86400 AND NOT list_contains(used, x.k)), lambda x: {{'d': abs(x.t - s.t), 't': x.t, 'k': x.k}})) AS b FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1 LEFT JOIN ps ON ps.user_id = f.user_id)),
done AS (SELECT user_id, max(i) AS n, max(len(used)) AS matched, max(shift) AS shift FROM f GROUP BY 1)
SELECT user_id, coalesce(matched, 0)::BIGINT AS matched, (coalesce(n, 0) - coalesce(matched, 0))::BIGINT AS lost, (coalesce(len(ps), 0) - coalesce(matched, 0))::BIGINT AS added, coalesce(shift, 0) AS shift FROM done FULL JOIN ps USING (user_id)"""


@query("train_diff", GREEDY)
def train_diff(spark, sf):
    """Per user: signups matched one to one with purchases within a day, greedily in time; lost, added and shift."""
    return greedy_train_match(of_type(spark, sf, "signup"), of_type(spark, sf, "purchase"), ["user_id"], 86_400.0)
