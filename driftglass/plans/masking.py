"""Masks per consumer, gates on them, and what they cost."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.functions.robust import half_even, ratio
from driftglass.operators import masks as M
from driftglass.operators import runs as R
from driftglass.operators.joins import overlap_join
from driftglass.sources.shared import shared_folder, staged

from .base import FRAMES, events, frames, query, scored, table
from .detection import ENTER, HYST, LEAVE
from .matching import SIGNUPS, hyst, of_type

# Consumers read some signals each; a declared (consumer, signal) has a mask even without spans.
CONSUMERS = [("rate", "click"), ("rate", "view"), ("spikes", "error"), ("spikes", "purchase"), ("slow", "signup"), ("slow", "view")]
DIMS = "dims AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in CONSUMERS) + ") AS d(consumer, signal))"
GRID = "grid AS (SELECT unnest(generate_series(min(frame), max(frame))) AS frame FROM frames)"
MASKS = f"{HYST}, {DIMS}, {GRID}, masks AS (SELECT d.consumer, d.signal, g.frame, count(h.start) > 0 AS invalid FROM dims d CROSS JOIN grid g LEFT JOIN hyst h ON h.signal = d.signal AND g.frame >= h.start AND g.frame < h.stop GROUP BY 1, 2, 3)"


def built(spark, sf):
    """Run-length masks: (consumer, signal, start, stop) invalid spans, and the bounds of the grid."""
    dims = spark.createDataFrame(CONSUMERS, "consumer string, signal string")
    bounds = frames(spark, sf).agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi"))
    return staged(M.build(hyst(spark, sf).select("signal", "start", "stop"), dims, bounds), shared_folder(spark, "masks"), "spans")


@query("build_masks", f"WITH {MASKS} SELECT consumer, signal, count(*) AS n_frames, count(*) FILTER (invalid) AS n_invalid FROM masks GROUP BY 1, 2")
def build_masks(spark, sf):
    return M.totals(built(spark, sf)).select("consumer", "signal", "n_frames", "n_invalid")


@query("retention", f"WITH {MASKS}, r AS (SELECT consumer, signal, 1 - count(*) FILTER (invalid)::DOUBLE / count(*) AS kept FROM masks GROUP BY 1, 2) SELECT consumer, signal, round(kept, 6) AS kept, round(avg(kept) OVER (PARTITION BY consumer), 6) AS mean_kept FROM r")
def retention(spark, sf):
    r = M.totals(built(spark, sf)).withColumn("kept", 1 - ratio(F.col("n_invalid"), F.col("n_frames")))
    return r.select("consumer", "signal", F.round("kept", 6).alias("kept"), F.round(F.avg("kept").over(Window.partitionBy("consumer")), 6).alias("mean_kept"))


@query("blank_hold", f"WITH {MASKS}, r AS (SELECT consumer, signal, count(*) FILTER (invalid)::DOUBLE / count(*) AS f FROM masks GROUP BY 1, 2), m AS (SELECT quantile_cont(f, 0.5) AS med FROM r) SELECT consumer, signal, concat_ws('|', CASE WHEN f > 0.02 THEN 'above share' END, CASE WHEN f > 1.5 * greatest(med, 0.01) THEN 'above median' END, CASE WHEN 1 - f < 0.99 THEN 'low retention' END) AS reasons FROM r, m WHERE f > 0.02 OR f > 1.5 * greatest(med, 0.01) OR 1 - f < 0.99")
def blank_hold(spark, sf):
    """Holds with all their reasons: too large a share, far above the group's median, too little kept."""
    r = M.totals(built(spark, sf)).withColumn("f", ratio(F.col("n_invalid"), F.col("n_frames")))
    return M.hold(r, "f", share=0.02, times=1.5, floor=0.01, least_kept=0.99).select("consumer", "signal", F.concat_ws("|", "reasons").alias("reasons"))


@query("mask_union", f"WITH {MASKS} SELECT consumer, count(*) FILTER (bad) AS n_invalid FROM (SELECT consumer, frame, bool_or(invalid) AS bad FROM masks GROUP BY 1, 2) GROUP BY 1")
def mask_union(spark, sf):
    """A frame is invalid if it is for any signal of the consumer."""
    spans = built(spark, sf)
    length = R.union_length(spans.where("start is not null").select("consumer", "start", "stop"), ["consumer"], block=R.BLOCK)
    return spans.select("consumer").distinct().join(length, "consumer", "left").select("consumer", F.coalesce("length", F.lit(0)).alias("n_invalid"))


@query("mask_to_spans", f"WITH {MASKS}, i AS (SELECT *, frame - row_number() OVER (PARTITION BY consumer, signal ORDER BY frame) AS g FROM masks WHERE invalid), r AS (SELECT consumer, signal, min(frame) AS a, max(frame) + 1 AS b FROM i GROUP BY consumer, signal, g) SELECT consumer, signal, round_even(a * 12.5, 0)::BIGINT AS first_sample, round_even(b * 12.5, 0)::BIGINT AS last_sample FROM r")
def mask_to_spans(spark, sf):
    """Invalid runs in samples of another rate, rounded half to even."""
    spans = R.merge_intervals(built(spark, sf).where("start is not null").select("consumer", "signal", "start", "stop"), ["consumer", "signal"], block=R.BLOCK)
    return spans.select("consumer", "signal", half_even(F.col("start") * 12.5).alias("first_sample"), half_even(F.col("stop") * 12.5).alias("last_sample"))


@query("time_lost", f"WITH {MASKS}, w AS (SELECT frame, bool_or(invalid) FILTER (consumer = 'rate') AS a, bool_or(invalid) FILTER (consumer = 'slow') AS b FROM masks WHERE consumer IN ('rate', 'slow') GROUP BY 1) SELECT count(*) FILTER (a OR b) AS either, count(*) FILTER (a AND NOT b) AS only_rate, count(*) FILTER (b AND NOT a) AS only_slow, count(*) FILTER (a AND b) AS both_, round(count(*) FILTER (a OR b)::DOUBLE / count(*), 6) AS share FROM w")
def time_lost(spark, sf):
    """Frames that either consumer lost, or both: lengths of unions, merged inside blocks."""
    spans = built(spark, sf)
    lost = spans.where(F.col("consumer").isin("rate", "slow") & F.col("start").isNotNull())
    each = lost.select(F.explode(F.array(F.col("consumer"), F.lit("either"))).alias("cover"), "start", "stop")
    length = lambda name: F.coalesce(F.sum(F.when(F.col("cover") == name, F.col("length"))), F.lit(0)).alias(name)
    row = R.union_length(each, ["cover"], block=R.BLOCK).agg(length("rate"), length("slow"), length("either"))
    n = spans.agg(F.max(F.col("hi") - F.col("lo"))).scalar()
    rate, slow, either = F.col("rate"), F.col("slow"), F.col("either")
    return row.select("either", (either - slow).alias("only_rate"), (either - rate).alias("only_slow"), (rate + slow - either).alias("both_"), F.round(ratio(either, n), 6).alias("share"))


@query("route_counts", "WITH d AS (SELECT c_mktsegment AS consumer, CASE WHEN c_acctbal < 0 THEN 'reject' WHEN c_acctbal > 9990 THEN 'clip' ELSE 'keep' END AS route FROM customer), r AS (SELECT unnest(['clip', 'keep', 'line', 'reject']) AS route), s AS (SELECT DISTINCT consumer FROM d) SELECT s.consumer, r.route, count(d.route) AS n FROM s CROSS JOIN r LEFT JOIN d ON d.consumer = s.consumer AND d.route = r.route GROUP BY 1, 2")
def route_counts(spark, sf):
    """Counts by consumer and route, with zeros for routes that do not occur."""
    bal = F.col("c_acctbal")
    d = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("consumer"), F.when(bal < 0, "reject").when(bal > 9990, "clip").otherwise("keep").alias("route"))
    routes = ["clip", "keep", "line", "reject"]
    wide = d.groupBy("consumer").agg(*(F.count_if(F.col("route") == r).alias(r) for r in routes))
    return wide.unpivot("consumer", routes, "route", "n")


@query("taper_apply", f"WITH {HYST}, p AS (SELECT signal, frame, rms FROM frames), d AS (SELECT p.signal, p.frame, any_value(rms) AS rms, min(CASE WHEN h.start IS NULL THEN NULL WHEN frame < h.start THEN h.start - frame - 1 WHEN frame >= h.stop THEN frame - h.stop ELSE -1 END) AS d FROM p LEFT JOIN hyst h ON h.signal = p.signal AND frame >= h.start - 4 AND frame < h.stop + 4 GROUP BY 1, 2) SELECT signal, count(*) FILTER (d = -1) AS masked, count(*) FILTER (d >= 0) AS tapered, round(sum(CASE WHEN d = -1 THEN NULL WHEN d IS NULL THEN rms ELSE rms * 0.5 * (1 - cos(pi() * (d + 1) / 5)) END), 6) AS total FROM d GROUP BY 1")
def taper_apply(spark, sf):
    """Masked frames become null; the four frames on either side are weighted by a raised cosine of their distance."""
    wide = hyst(spark, sf).select("signal", (F.col("start") - 4).alias("r_start"), (F.col("stop") + 4).alias("r_stop"))
    cells = frames(spark, sf).select("signal", F.col("frame").alias("start"), (F.col("frame") + 1).alias("stop"), "rms")
    inside = (F.col("start") >= F.col("r_start") + 4) & (F.col("start") < F.col("r_stop") - 4)
    distance = F.when(inside, -1).when(F.col("start") < F.col("r_start") + 4, F.col("r_start") + 3 - F.col("start")).otherwise(F.col("start") - F.col("r_stop") + 4)
    near = overlap_join(cells, wide, ["signal"], 64).groupBy("signal", "start").agg(F.min(distance).alias("d"))
    d = cells.join(near, ["signal", "start"], "left")
    weighted = F.when(F.col("d") == -1, None).when(F.col("d").isNull(), F.col("rms")).otherwise(F.col("rms") * M.taper(F.col("d"), 4))
    return d.groupBy("signal").agg(F.count_if(F.col("d") == -1).alias("masked"), F.count_if(F.col("d") >= 0).alias("tapered"), F.round(F.sum(weighted), 6).alias("total"))


@query("empty_windows", f"WITH {FRAMES}, w AS (SELECT unnest(generate_series(min(frame) // 6, max(frame) // 6)) AS w FROM frames), s AS (SELECT DISTINCT signal FROM frames) SELECT s.signal, w.w * 6 AS start, CASE WHEN count(e.value) = 0 THEN 'empty' ELSE 'quiet' END AS status FROM s CROSS JOIN w LEFT JOIN events e ON e.event_type = s.signal AND epoch_us(ts) // 21600000000 = w.w GROUP BY 1, 2 HAVING count(e.value) <= 8")
def empty_windows(spark, sf):
    """Fixed windows of the region with few or no events."""
    f = frames(spark, sf)
    grid = f.agg(F.sequence(F.expr("min(frame) div 6"), F.expr("max(frame) div 6")).alias("w"), F.collect_set("signal").alias("s")).select(F.explode("w").alias("w"), "s").select("w", F.explode("s").alias("signal"))
    n = events(spark, sf).groupBy(F.col("event_type").alias("signal"), F.expr("us div 21600000000").alias("w")).agg(F.count("value").alias("n"))
    few = grid.join(n, ["signal", "w"], "left").fillna(0, ["n"]).where("n <= 8")
    return few.select("signal", (F.col("w") * 6).alias("start"), F.when(F.col("n") == 0, "empty").otherwise("quiet").alias("status"))


@query("peri_event_spans", f"WITH {SIGNUPS}, w AS (SELECT user_id, t - 1800 AS a, t + 1800 AS b FROM su), n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM w), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM n), m AS (SELECT user_id, min(a) AS a, max(b) AS b FROM r GROUP BY user_id, run) SELECT user_id, count(*) AS n, round(sum(b - a), 3) AS seconds FROM m GROUP BY 1")
def peri_event_spans(spark, sf):
    spans = of_type(spark, sf, "signup").select("user_id", (F.col("t") - 1800).alias("start"), (F.col("t") + 1800).alias("stop"))
    return R.merge_intervals(spans, ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("stop") - F.col("start")), 3).alias("seconds"))


@query("gated_mask", f"WITH {SIGNUPS}, cl AS (SELECT epoch_us(ts) / 1000000.0::DOUBLE AS t, value FROM events WHERE event_type = 'click'), g AS (SELECT su.event_id, max(cl.value) AS top FROM su JOIN cl ON cl.t >= su.t - 300 AND cl.t < su.t + 300 GROUP BY 1) SELECT event_id, round(top, 6) AS top FROM g WHERE top > 60")
def gated_mask(spark, sf):
    """Windows around events, only where the signal inside them exceeds a level."""
    s = of_type(spark, sf, "signup").select("event_id", (F.col("t") - 300).alias("start"), (F.col("t") + 300).alias("stop"))
    c = of_type(spark, sf, "click").select(F.col("t").alias("r_start"), (F.col("t") + 1e-6).alias("r_stop"), "value")
    return overlap_join(s, c, [], 3600.0).groupBy("event_id").agg(F.round(F.max("value"), 6).alias("top")).where("top > 60")


GATED = f"{HYST}, gg AS (SELECT h.*, bool_or(z.z > 2.5) AS strong, count(*) FILTER (z.z > 2.0) >= 2 AS long FROM hyst h JOIN scored z ON z.signal = h.signal AND z.frame >= h.start AND z.frame < h.stop GROUP BY ALL)"


@query("gated_masks", f"WITH {GATED} SELECT signal, 'strong or long' AS gate, count(*) FILTER (strong OR long) AS passed, coalesce(sum(stop - start + 2) FILTER (strong OR long), 0)::BIGINT AS frames FROM gg GROUP BY 1 UNION ALL SELECT signal, 'strong', count(*) FILTER (strong), coalesce(sum(stop - start + 2) FILTER (strong), 0)::BIGINT FROM gg GROUP BY 1")
def gated_masks(spark, sf):
    """Spans enter a mask, padded, only if they pass the gate; one count per gate."""
    z = scored(spark, sf)
    g = R.hysteresis(z, ["signal"], "frame", F.col("z") > ENTER, F.col("z") > LEAVE, top=F.max("z"))
    cells = z.where(F.col("z") > ENTER).select("signal", F.col("frame").alias("r_start"), (F.col("frame") + 1).alias("r_stop"))
    n = overlap_join(g, cells, ["signal"], 64).groupBy("signal", "start").agg(F.count("*").alias("n"))
    g = g.join(n, ["signal", "start"], "left").withColumn("strong", F.col("top") > 2.5)
    gates = F.explode(F.array(F.struct(F.lit("strong or long").alias("gate"), (F.col("strong") | (F.col("n") >= 2)).alias("ok")), F.struct(F.lit("strong").alias("gate"), F.col("strong").alias("ok"))))
    flat = g.select("signal", (F.col("stop") - F.col("start") + 2).alias("len"), gates.alias("g"))
    return flat.groupBy("signal", "g.gate").agg(F.count_if("g.ok").alias("passed"), F.coalesce(F.sum(F.when(F.col("g.ok"), F.col("len"))), F.lit(0)).alias("frames"))


@query("span_rescale", f"WITH {HYST} SELECT signal, start, floor(start / 5.0)::BIGINT AS down_start, ceil(stop / 5.0)::BIGINT AS down_stop, floor(start / 5.0)::BIGINT * 5 AS back_start FROM hyst")
def span_rescale(spark, sf):
    """Spans of masked data at a lower rate: floor of the start, ceiling of the stop."""
    down = F.floor(F.col("start") / 5)
    return hyst(spark, sf).select("signal", "start", down.alias("down_start"), F.ceil(F.col("stop") / 5).alias("down_stop"), (down * 5).alias("back_start"))


@query("trim_series", f"WITH {FRAMES}, cut AS (SELECT signal, min(frame) + CASE WHEN signal IN ('click', 'view') THEN 24 ELSE 72 END AS cut FROM frames GROUP BY 1) SELECT signal, count(*) FILTER (frame < cut) AS trimmed, round(avg(CASE WHEN frame >= cut THEN rms END), 6) AS mean FROM frames JOIN cut USING (signal) GROUP BY 1")
def trim_series(spark, sf):
    """Each series is cut at its own time and averaged again."""
    f = frames(spark, sf)
    cuts = f.groupBy("signal").agg(F.min("frame").alias("lo")).select("signal", (F.col("lo") + F.when(F.col("signal").isin("click", "view"), 24).otherwise(72)).alias("cut"))
    kept = F.when(F.col("frame") >= F.col("cut"), F.col("rms"))
    return f.join(cuts, "signal").groupBy("signal").agg(F.count_if(F.col("frame") < F.col("cut")).alias("trimmed"), F.round(F.avg(kept), 6).alias("mean"))


@query("split_epochs", f"WITH {FRAMES}, b AS (SELECT signal, min(frame) + 200 AS split FROM frames GROUP BY 1) SELECT signal, CASE WHEN frame < split THEN 'stim' ELSE 'recovery' END AS epoch, count(*) AS n, min(frame - CASE WHEN frame < split THEN split - 200 ELSE split END) AS first, max(frame - CASE WHEN frame < split THEN split - 200 ELSE split END) AS last FROM frames JOIN b USING (signal) GROUP BY 1, 2")
def split_epochs(spark, sf):
    """Two epochs of each recording, each with its own zero."""
    f = frames(spark, sf)
    split = f.groupBy("signal").agg((F.min("frame") + 200).alias("split"))
    early = F.col("frame") < F.col("split")
    at = F.col("frame") - F.when(early, F.col("split") - 200).otherwise(F.col("split"))
    return f.join(split, "signal").groupBy("signal", F.when(early, "stim").otherwise("recovery").alias("epoch")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


@query("common_start", "WITH a AS (SELECT o_custkey, o_orderpriority AS level, min(date_diff('day', DATE '1992-01-01', o_orderdate::DATE)) AS settle FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey, max(settle) AS common, count(*) AS levels FROM a GROUP BY 1) SELECT o_custkey, common, levels FROM m")
def common_start(spark, sf):
    """The common start is the largest over levels of each level's own earliest."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    level = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.min(day).alias("settle"))
    return level.groupBy("o_custkey").agg(F.max("settle").alias("common"), F.count("*").alias("levels"))


@query("gap_to_invalid", f"WITH {HYST}, f AS (SELECT DISTINCT frame, signal FROM frames WHERE signal = 'click'), x AS (SELECT f.frame, max(h.stop) FILTER (h.stop <= f.frame) AS prev, min(h.start) FILTER (h.start > f.frame) AS next FROM f LEFT JOIN hyst h ON h.signal = f.signal GROUP BY 1) SELECT frame, frame - prev AS since, next - frame AS until FROM x")
def gap_to_invalid(spark, sf):
    """Frames since the last invalid run's end and until the next one's start."""
    from driftglass.operators.joins import as_of

    f = frames(spark, sf).where("signal = 'click'").select("signal", F.col("frame").cast("double").alias("t"), "frame")
    h = hyst(spark, sf).where("signal = 'click'")
    back = as_of(f, h.select("signal", F.col("stop").cast("double").alias("t")), ["signal"], 64.0).withColumnRenamed("e_t", "prev")
    both = as_of(back, h.select("signal", F.col("start").cast("double").alias("t")), ["signal"], 64.0, forward=True, strict=True)
    return both.select("frame", (F.col("frame") - F.col("prev").cast("long")).alias("since"), (F.col("e_t").cast("long") - F.col("frame")).alias("until"))
