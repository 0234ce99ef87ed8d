"""Ordered windows, sequential folds, ranking and selection."""

from __future__ import annotations

from math import log

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.functions.robust import ratio
from driftglass.operators import ranking as K
from driftglass.operators import runs as R

from .base import FRAMES, REFS, SCORED, events, frames, query, scored, table
from .detection import ISLANDS, rounded

W = "PARTITION BY signal ORDER BY frame"


@query("rms_envelope", f"WITH {FRAMES} SELECT signal, frame, round(sqrt(avg(rms * rms) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 6) AS env FROM frames QUALIFY frame % 4 = 0")
def rms_envelope(spark, sf):
    """Centred root mean square over seven frames, cut at the edges, on a coarser grid."""
    w = Window.partitionBy("signal").orderBy("frame").rowsBetween(-3, 3)
    env = frames(spark, sf).withColumn("env", F.sqrt(F.avg(F.col("rms") * F.col("rms")).over(w)))
    return rounded(env.where("frame % 4 = 0").select("signal", "frame", "env"), "env")


@query("moving_mean", f"WITH {FRAMES}, m AS (SELECT signal, frame, avg(rms) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM frames) SELECT signal, frame, round(a, 6) AS smooth, round(sqrt(avg(a * a) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)), 6) AS level FROM m")
def moving_mean(spark, sf):
    w = Window.partitionBy("signal").orderBy("frame")
    a = frames(spark, sf).select("signal", "frame", F.avg("rms").over(w.rowsBetween(-2, 2)).alias("smooth"))
    return rounded(a.withColumn("level", F.sqrt(F.avg(F.col("smooth") * F.col("smooth")).over(w.rowsBetween(-5, 5)))), "smooth", "level")


BOX = f"{FRAMES}, s AS (SELECT *, row_number() OVER ({W}) AS i, sum(rms) OVER ({W} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS inside, count(*) OVER ({W} ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS k, sum(rms) OVER (PARTITION BY signal) AS total, count(*) OVER (PARTITION BY signal) AS n FROM frames), b AS (SELECT *, inside / k - (total - inside) / (n - k) AS score FROM s WHERE k = 24)"


def boxcar(spark, sf):
    w = Window.partitionBy("signal")
    box = w.orderBy("frame").rowsBetween(0, 23)
    s = frames(spark, sf).select("signal", "frame", "rms", F.sum("rms").over(box).alias("inside"), F.count("*").over(box).alias("k"), F.sum("rms").over(w).alias("total"), F.count("*").over(w).alias("n"))
    return s.where("k = 24").withColumn("score", F.col("inside") / 24 - (F.col("total") - F.col("inside")) / (F.col("n") - 24))


@query("matched_boxcar", f"WITH {BOX}, r AS (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY round(score, 9) DESC, frame) AS j FROM b) SELECT signal, frame AS onset, round(score, 6) AS score FROM r WHERE j = 1")
def matched_boxcar(spark, sf):
    """Where the mean inside a window of known width most exceeds the mean outside; the first of equals."""
    best = boxcar(spark, sf).groupBy("signal").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "frame", "score")).alias("m"))
    return best.select("signal", F.col("m.frame").alias("onset"), F.round("m.score", 6).alias("score"))


@query("walk_extent", f"WITH {BOX}, o AS (SELECT signal, max_by(frame, (round(score, 9), -frame)) AS onset FROM b GROUP BY 1), m AS (SELECT signal, quantile_cont(rms, 0.5) AS c FROM frames GROUP BY 1), hot AS (SELECT f.signal, f.frame, CASE WHEN f.frame - lag(f.frame) OVER (PARTITION BY f.signal ORDER BY f.frame) <= 6 THEN 0 ELSE 1 END AS new FROM frames f JOIN m USING (signal) WHERE rms > c), g AS (SELECT *, sum(new) OVER ({W}) AS run FROM hot), r AS (SELECT signal, min(frame) AS start, max(frame) + 1 AS stop FROM g GROUP BY signal, run) SELECT r.signal, min(r.start) AS start, max(r.stop) AS stop FROM r JOIN o ON o.signal = r.signal AND r.start < o.onset + 24 AND r.stop > o.onset GROUP BY 1")
def walk_extent(spark, sf):
    """Outward from the window until the trace stays below its median for more than five frames."""
    b = boxcar(spark, sf)
    onset = b.groupBy("signal").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "frame")).alias("m")).select("signal", F.col("m.frame").alias("onset"))
    f = frames(spark, sf)
    level = f.groupBy("signal").agg(F.percentile("rms", F.lit(0.5)).alias("c"))
    hot = f.join(level, "signal").where("rms > c").select("signal", F.col("frame").alias("start"), (F.col("frame") + 1).alias("stop"))
    found = R.merge_intervals(hot, ["signal"], 5)
    return found.join(onset, "signal").where("start < onset + 24 and stop > onset").groupBy("signal").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


@query("rolling_median", f"WITH {FRAMES} SELECT signal, frame, round(quantile_cont(rms, 0.5) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS med, round(quantile_cont(rms, 0.5) OVER ({W} RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING), 6) AS med_time FROM frames")
def rolling_median(spark, sf):
    w = Window.partitionBy("signal").orderBy("frame")
    med = F.percentile("rms", F.lit(0.5))
    return rounded(frames(spark, sf).select("signal", "frame", med.over(w.rowsBetween(-10, 10)).alias("med"), med.over(w.rangeBetween(-10, 10)).alias("med_time")), "med", "med_time")


PEAKS = f"{SCORED}, p AS (SELECT signal, frame, z FROM (SELECT signal, frame, z, lag(z) OVER ({W}) AS a, lead(z) OVER ({W}) AS b FROM scored WHERE z IS NOT NULL) WHERE z > 0.5 AND z > a AND z >= b)"


def peaks(spark, sf):
    """Local maxima over half a sigma."""
    w = Window.partitionBy("signal").orderBy("frame")
    near = scored(spark, sf).where("z is not null").select("signal", "frame", "z", F.lag("z").over(w).alias("a"), F.lead("z").over(w).alias("b"))
    return near.where("z > 0.5 and z > a and z >= b").select("signal", "frame", "z")


@query("threshold_crossings", f"WITH RECURSIVE {PEAKS}, q AS (SELECT *, row_number() OVER ({W}) AS i FROM p), f AS (SELECT signal, i, frame, frame AS kept FROM q WHERE i = 1 UNION ALL SELECT q.signal, q.i, q.frame, CASE WHEN q.frame - f.kept >= 6 THEN q.frame ELSE f.kept END FROM f JOIN q ON q.signal = f.signal AND q.i = f.i + 1) SELECT signal, kept AS frame, kept - lag(kept) OVER (PARTITION BY signal ORDER BY kept) AS gap FROM (SELECT DISTINCT signal, kept FROM f)")
def threshold_crossings(spark, sf):
    """Peaks with a refractory time: the first one stays, later ones within six frames of the last kept go."""
    kept = K.refractory(peaks(spark, sf), ["signal"], "frame", 6)
    return kept.select("signal", "frame", (F.col("frame") - F.lag("frame").over(Window.partitionBy("signal").orderBy("frame"))).alias("gap"))


@query("nms", f"WITH RECURSIVE {PEAKS}, q AS (SELECT *, row_number() OVER ({W}) AS i FROM p), f AS (SELECT signal, i, 1 AS run, frame AS kept, z FROM q WHERE i = 1 UNION ALL SELECT q.signal, q.i, CASE WHEN q.frame - f.kept < 8 THEN f.run ELSE f.run + 1 END, CASE WHEN q.frame - f.kept < 8 AND q.z <= f.z THEN f.kept ELSE q.frame END, CASE WHEN q.frame - f.kept < 8 AND q.z <= f.z THEN f.z ELSE q.z END FROM f JOIN q ON q.signal = f.signal AND q.i = f.i + 1), l AS (SELECT *, row_number() OVER (PARTITION BY signal, run ORDER BY i DESC) AS j FROM f) SELECT signal, kept AS frame, round(z, 6) AS z FROM l WHERE j = 1")
def nms(spark, sf):
    """In time order: closer than eight frames to the last kept, the stronger takes its place; equals keep the earlier."""
    return rounded(K.suppress(peaks(spark, sf), ["signal"], "frame", "z", 8), "z")


@query("peak_to_trough", f"WITH {PEAKS}, a AS (SELECT s.signal, s.frame, s.rms, p.z, count(p.frame) OVER (PARTITION BY s.signal ORDER BY s.frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg FROM scored s LEFT JOIN p USING (signal, frame)), t AS (SELECT *, min(rms) OVER (PARTITION BY signal, seg ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS trough FROM a) SELECT signal, frame, round(rms - trough, 6) AS amp FROM t WHERE z IS NOT NULL AND seg > 0")
def peak_to_trough(spark, sf):
    """A peak above the least value since the peak before it."""
    w = Window.partitionBy("signal").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    a = scored(spark, sf).drop("z").join(peaks(spark, sf), ["signal", "frame"], "left").withColumn("seg", F.count("z").over(w))
    t = a.withColumn("trough", F.min("rms").over(Window.partitionBy("signal", "seg").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)))
    return t.where("z is not null and seg > 0").select("signal", "frame", F.round(F.col("rms") - F.col("trough"), 6).alias("amp"))


@query("pooled_rate_series", f"WITH {PEAKS}, c AS (SELECT signal, unnest(generate_series(min(frame) + 24, max(frame) - 24, 12)) AS centre FROM frames GROUP BY 1) SELECT c.signal, c.centre, count(f.frame) AS valid, count(p.frame) AS n, round(count(p.frame)::DOUBLE / nullif(count(f.frame), 0), 6) AS rate FROM c LEFT JOIN frames f ON f.signal = c.signal AND f.frame >= c.centre - 24 AND f.frame < c.centre + 24 LEFT JOIN p ON p.signal = f.signal AND p.frame = f.frame GROUP BY 1, 2 HAVING count(f.frame) >= 24")
def pooled_rate_series(spark, sf):
    """Peaks per valid frame in windows of 48 frames every 12: each frame goes to the windows that hold it."""
    f = frames(spark, sf)
    start = f.groupBy("signal").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    marked = f.join(peaks(spark, sf).select("signal", "frame", F.lit(1).alias("peak")), ["signal", "frame"], "left").join(start, "signal")
    first = F.ceil((F.col("frame") - F.col("lo") - 47) / 12)
    each = marked.withColumn("k", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(F.floor((F.col("frame") - F.col("lo")) / 12), F.lit(0)))))
    centre = F.col("lo") + 24 + 12 * F.col("k")
    inside = each.withColumn("centre", centre).where("frame >= centre - 24 and frame < centre + 24 and centre <= hi - 24")
    return inside.groupBy("signal", "centre").agg(F.count("*").alias("valid"), F.count("peak").alias("n")).where("valid >= 24").withColumn("rate", F.round(ratio(F.col("n"), F.col("valid")), 6))


PVALS = "pv AS (SELECT l_suppkey AS k, l_returnflag AS g, exp(-abs(avg(l_quantity) - 25.5) * 4) * 0.2 AS p FROM lineitem GROUP BY 1, 2)"


def pvalues(spark, sf):
    p = F.exp(-F.abs(F.avg("l_quantity") - 25.5) * 4) * 0.2
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("g")).agg(p.alias("p"))


@query("holm", f"WITH {PVALS}, r AS (SELECT *, row_number() OVER (ORDER BY p, k, g) AS i, count(*) OVER () AS m FROM pv), t AS (SELECT *, bool_and(p <= 0.01 / (m - i + 1)) OVER (ORDER BY i) AS rejected FROM r) SELECT k, g, rejected FROM t WHERE rejected")
def holm(spark, sf):
    """Step-down over all tests: stops at the first that fails."""
    return K.holm(pvalues(spark, sf), [], "p", 0.01, ["k", "g"]).where("rejected").select("k", "g", "rejected")


@query("holm_by_group", f"WITH {PVALS}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, k) AS i, count(*) OVER (PARTITION BY g) AS m FROM pv), t AS (SELECT *, bool_and(p <= 0.01 / (m - i + 1)) OVER (PARTITION BY g ORDER BY i) AS rejected FROM r) SELECT g, count(*) AS tests, count(*) FILTER (rejected) AS rejected FROM t GROUP BY 1")
def holm_by_group(spark, sf):
    found = K.holm(pvalues(spark, sf), ["g"], "p", 0.01, ["k"])
    return found.groupBy("g").agg(F.count("*").alias("tests"), F.count_if("rejected").alias("rejected"))


@query("latest_per_key", "WITH a AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events) SELECT user_id, event_id, CASE WHEN event_type <> first THEN 'conflict' ELSE event_type END AS judgement FROM a WHERE i = 1")
def latest_per_key(spark, sf):
    """The latest judgement per key; one that contradicts the first becomes a conflict, not an overwrite."""
    at = F.struct("us", "event_id", "event_type")
    a = events(spark, sf).groupBy("user_id").agg(F.max(at).alias("last"), F.min(at).alias("first"))
    same = F.col("last.event_type") == F.col("first.event_type")
    return a.select("user_id", "last.event_id", F.when(same, F.col("last.event_type")).otherwise("conflict").alias("judgement"))


@query("missing_multiple", f"WITH {FRAMES}, g AS (SELECT signal, frame, frame - lag(frame) OVER ({W}) AS rr, quantile_cont(rms, 0.5) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS local FROM frames) SELECT signal, frame, (rr - 1)::BIGINT AS missing FROM g WHERE rr >= 2 AND abs(rr - round_even(rr, 0)) <= 0.4 AND local > 0")
def missing_multiple(spark, sf):
    w = Window.partitionBy("signal").orderBy("frame")
    g = frames(spark, sf).withColumn("rr", F.col("frame") - F.lag("frame").over(w))
    return g.where((F.col("rr") >= 2) & (F.abs(F.col("rr") - F.rint("rr")) <= 0.4)).select("signal", "frame", (F.col("rr") - 1).alias("missing"))


@query("review_order", "WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS k, o_orderdate FROM orders WHERE o_totalprice > 300000) SELECT o_orderkey, k::INTEGER AS k, row_number() OVER (ORDER BY k, o_orderdate, o_orderkey) AS place FROM s ORDER BY place LIMIT 100")
def review_order(spark, sf):
    """The first hundred rows for review: by status, then date."""
    k = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    top = table(spark, sf, "orders").where("o_totalprice > 300000").select("o_orderkey", k.alias("k"), "o_orderdate").orderBy("k", "o_orderdate", "o_orderkey").limit(100)
    return top.select("o_orderkey", "k", F.row_number().over(Window.orderBy("k", "o_orderdate", "o_orderkey")).cast("long").alias("place"))


@query("best_channel", "WITH c AS (SELECT o_custkey AS rec, o_orderpriority AS channel, count(*) AS n, max(o_totalprice) / avg(o_totalprice) AS snr, avg((o_orderstatus = 'P')::INTEGER) AS bad FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY snr DESC, n DESC, channel) AS i FROM c WHERE bad <= 0.5) SELECT rec, channel, round(snr, 6) AS snr FROM r WHERE i = 1")
def best_channel(spark, sf):
    """After the vetoes the largest ratio per recording; none where nothing survives."""
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("rec"), F.col("o_orderpriority").alias("channel")).agg(F.count("*").alias("n"), (F.max("o_totalprice") / F.avg("o_totalprice")).alias("snr"), F.avg((F.col("o_orderstatus") == "P").cast("int")).alias("bad"))
    best = c.where("bad <= 0.5").groupBy("rec").agg(F.min(F.struct((-F.col("snr")).alias("s"), (-F.col("n")).alias("n"), "channel")).alias("m"))
    return best.select("rec", "m.channel", F.round(-F.col("m.s"), 6).alias("snr"))


@query("gated_selection", "WITH c AS (SELECT o_custkey AS rec, o_orderpriority AS channel, count(*) AS n, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2), k AS (SELECT rec, bool_or(channel = '1-URGENT' AND score > 150000) AS incumbent, max_by(channel, (score, channel)) FILTER (n >= 2) AS best, max_by(channel, (score, channel)) AS single FROM c GROUP BY 1) SELECT rec, CASE WHEN incumbent THEN '1-URGENT' WHEN best IS NOT NULL THEN best ELSE single END AS chosen, CASE WHEN incumbent THEN 'incumbent' WHEN best IS NOT NULL THEN 'best' ELSE 'single' END AS why FROM k")
def gated_selection(spark, sf):
    """Precedence: an incumbent that passes, the best with enough rows, then the best at all."""
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("rec"), F.col("o_orderpriority").alias("channel")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("score"))
    by = F.struct("score", "channel")
    k = c.groupBy("rec").agg(F.bool_or((F.col("channel") == "1-URGENT") & (F.col("score") > 150000)).alias("inc"), F.max(F.when(F.col("n") >= 2, by)).alias("best"), F.max(by).alias("single"))
    has = F.col("best").isNotNull()
    return k.select("rec", F.when(F.col("inc"), "1-URGENT").when(has, F.col("best.channel")).otherwise(F.col("single.channel")).alias("chosen"), F.when(F.col("inc"), "incumbent").when(has, "best").otherwise("single").alias("why"))


@query("threshold_search", "WITH d AS (SELECT quality AS y, least(n_chars / 4000.0::DOUBLE, 1.0::DOUBLE) AS p FROM labels JOIN documents USING (doc_id)), g AS (SELECT unnest(generate_series(0, 100)) / 100.0::DOUBLE AS t), s AS (SELECT t, count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp, count(*) FILTER (y = 1 AND p < t) AS fn FROM g CROSS JOIN d GROUP BY 1), f AS (SELECT t, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM s) SELECT t AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC NULLS LAST, t LIMIT 1")
def threshold_search(spark, sf):
    """The best of 101 thresholds, the smallest of equals: rows fall into a grid once, counts are summed from above."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(K.best_threshold(rows.select(F.col("quality").alias("y"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("p")), 100), "f1")


@query("top_k", "WITH g AS (SELECT p_type, p_brand, avg(p_retailprice) AS v FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY v DESC, p_brand) AS i FROM g) SELECT p_type, p_brand, round(v, 6) AS v, i FROM r WHERE i <= 5")
def top_k(spark, sf):
    g = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.avg("p_retailprice").alias("v"))
    r = g.withColumn("i", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("v"), "p_brand")).cast("long"))
    return rounded(r.where("i <= 5"), "v")


@query("curve_sizes", "WITH b AS (SELECT count(*) AS n FROM labels), s AS (SELECT DISTINCT round_even(exp(ln(10) + i * (ln(n) - ln(10)) / 11), 0)::BIGINT AS size FROM b, generate_series(0, 11) AS t(i)) SELECT size FROM s")
def curve_sizes(spark, sf):
    """Log-spaced distinct sizes up to the rows there are."""
    n = table(spark, sf, "labels").agg(F.count("*").alias("n"))
    size = F.rint(F.exp(log(10) + F.col("i") * (F.log("n") - log(10)) / 11)).cast("long")
    return n.select("n", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).select(size.alias("size")).distinct()


@query("subsample", "SELECT source, count(*) AS n FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS i FROM documents) WHERE i <= 20 GROUP BY 1")
def subsample(spark, sf):
    """A deterministic sample per group: the rows whose ids hash lowest."""
    w = Window.partitionBy("source").orderBy(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), "doc_id")
    return table(spark, sf, "documents").select("doc_id", "source").withColumn("i", F.row_number().over(w)).where("i <= 20").groupBy("source").agg(F.count("*").alias("n"))


@query("pair_max", "WITH r AS (SELECT c_nationkey, c_acctbal AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT c_nationkey, round(sum((i - 1) * x) / (any_value(n) * (any_value(n) - 1) / 2.0), 6) AS pair_max, round(sum((n - i) * x) / (any_value(n) * (any_value(n) - 1) / 2.0), 6) AS pair_min FROM r GROUP BY 1")
def pair_max(spark, sf):
    """Mean over unordered pairs of the larger and the smaller, from ranks."""
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    r = table(spark, sf, "customer").select("c_nationkey", F.col("c_acctbal").alias("x"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("c_nationkey")).alias("n"))
    pairs = F.first("n") * (F.first("n") - 1) / 2.0
    return rounded(r.groupBy("c_nationkey").agg((F.sum((F.col("i") - 1) * F.col("x")) / pairs).alias("pair_max"), (F.sum((F.col("n") - F.col("i")) * F.col("x")) / pairs).alias("pair_min")), "pair_max", "pair_min")


PLAN = """WITH RECURSIVE r AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
t AS (SELECT source, 0::BIGINT AS i, NULL::BIGINT AS "at", NULL::VARCHAR AS chosen, MAP {'any': 0::BIGINT} AS uses FROM (SELECT DISTINCT source FROM documents)
UNION ALL SELECT source, i, "at", c, map_concat(uses, MAP {c: coalesce(uses[c], 0) + 1}) FROM (
SELECT t.source, r.i, r.doc_id AS "at", t.uses, CASE WHEN coalesce(t.uses[r.lang], 0) <= t.uses['any'] THEN r.lang ELSE 'any' END AS c FROM t JOIN r ON r.source = t.source AND r.i = t.i + 1))
SELECT source, "at", chosen FROM t WHERE i > 0"""


@query("condition_plan", PLAN)
def condition_plan(spark, sf):
    """Rows in order take the condition used least so far, the first of equals, per group."""
    rows = table(spark, sf, "documents").select("source", F.col("doc_id").alias("at"), F.array("lang", F.lit("any")).alias("allowed"))
    return K.balance(rows, ["source"], "at", "allowed")
