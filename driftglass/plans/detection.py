"""Detection: references, scores, runs, candidates, cores, rates and extents over framed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.functions.robust import half_even, ratio, reference
from driftglass.operators import runs as R
from driftglass.operators.candidates import Settings, candidates, cores
from driftglass.operators.joins import overlap_join

from .base import FRAMES, LOGS, REFS, SCORED, frames, query, scored

ENTER, LEAVE, GAP, LEAST = 2.0, 1.0, 3, 2
DRIVER = Settings(enter=ENTER, leave=LEAVE, merge_gap=GAP, least=LEAST)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("log_envelope", f"WITH {LOGS} SELECT signal, frame, round(x, 6) AS x FROM logs")
def log_envelope_query(spark, sf):
    return rounded(scored(spark, sf).select("signal", "frame", "x"), "x")


@query("epoch_reference", f"WITH {REFS} SELECT signal, round(center, 6) AS center, round(scale, 6) AS scale, n FROM refs WHERE scale >= 1e-6 AND n >= 100")
def epoch_reference(spark, sf):
    x = scored(spark, sf)
    return rounded(reference(x, ["signal"], "x"), "center", "scale")


@query("robust_z", f"WITH {SCORED} SELECT signal, frame, round(z, 6) AS z FROM scored")
def robust_z_query(spark, sf):
    return rounded(scored(spark, sf).select("signal", "frame", "z"), "z")


@query("robust_sigma", f"WITH {LOGS}, m AS (SELECT signal, quantile_cont(rms, 0.5) AS c FROM frames GROUP BY 1) SELECT signal, round(1.4826 * quantile_cont(abs(rms - c), 0.5), 6) AS mad_sigma, round(quantile_cont(abs(rms), 0.5) / 0.6745, 6) AS abs_sigma, round(1.4826 * quantile_cont(abs(rms - c), 0.5) / (quantile_cont(abs(rms), 0.5) / 0.6745), 6) AS sigma_ratio FROM frames JOIN m USING (signal) GROUP BY 1")
def robust_sigma(spark, sf):
    f = frames(spark, sf)
    mad = reference(f, ["signal"], "rms", 1).select("signal", F.col("scale").alias("mad_sigma"))
    both = f.groupBy("signal").agg((F.percentile(F.abs("rms"), F.lit(0.5)) / 0.6745).alias("abs_sigma")).join(mad, "signal")
    return rounded(both.withColumn("sigma_ratio", ratio(F.col("mad_sigma"), F.col("abs_sigma"))), "mad_sigma", "abs_sigma", "sigma_ratio")


ISLANDS = "g AS (SELECT *, frame - row_number() OVER (PARTITION BY signal ORDER BY frame) AS g FROM flagged)"


@query("true_runs", f"WITH {SCORED}, flagged AS (SELECT signal, frame, z FROM scored WHERE z > 1.0), {ISLANDS} SELECT signal, min(frame) AS start, max(frame) + 1 AS stop, round(max(z), 6) AS peak FROM g GROUP BY signal, g")
def true_runs(spark, sf):
    over = scored(spark, sf).where(F.col("z") > LEAVE)
    return rounded(R.true_runs(over, ["signal"], "frame", peak=F.max("z")), "peak")


@query("zero_runs", f"WITH {FRAMES}, n AS (SELECT signal, min(frame) AS lo, max(frame) AS hi FROM frames GROUP BY 1), grid AS (SELECT signal, unnest(generate_series(lo, hi)) AS frame FROM n), flagged AS (SELECT grid.* FROM grid ANTI JOIN frames USING (signal, frame)), {ISLANDS} SELECT signal, min(frame) AS start, count(*) AS length FROM g GROUP BY signal, g HAVING count(*) >= 2")
def zero_runs(spark, sf):
    """Runs of at least two frames without a value on the full grid of each signal."""
    f = frames(spark, sf)
    grid = f.groupBy("signal").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).select("signal", F.explode(F.sequence("lo", "hi")).alias("frame"))
    empty = grid.join(f.select("signal", "frame"), ["signal", "frame"], "left_anti")
    return R.true_runs(empty, ["signal"], "frame").select("signal", "start", (F.col("stop") - F.col("start")).alias("length")).where("length >= 2")


HYST = f"{SCORED}, flagged AS (SELECT signal, frame, z FROM scored WHERE z > 1.0), {ISLANDS}, hyst AS (SELECT signal, min(frame) AS start, max(frame) + 1 AS stop, max(z) AS peak FROM g GROUP BY signal, g HAVING bool_or(z > 2.0))"


@query("hysteresis", f"WITH {HYST} SELECT signal, start, stop, round(peak, 6) AS peak FROM hyst")
def hysteresis(spark, sf):
    z = scored(spark, sf)
    return rounded(R.hysteresis(z, ["signal"], "frame", F.col("z") > ENTER, F.col("z") > LEAVE, peak=F.max("z")), "peak")


MERGED = f"{HYST}, marked AS (SELECT *, CASE WHEN start - max(stop) OVER (PARTITION BY signal ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 10 THEN 0 ELSE 1 END AS new FROM hyst), runs AS (SELECT *, sum(new) OVER (PARTITION BY signal ORDER BY start) AS run FROM marked), merged AS (SELECT signal, min(start) AS start, max(stop) AS stop, count(*) AS members FROM runs GROUP BY signal, run)"


@query("merge_intervals", f"WITH {MERGED} SELECT signal, start, stop FROM merged")
def merge_intervals(spark, sf):
    z = scored(spark, sf)
    return R.merge_intervals(R.hysteresis(z, ["signal"], "frame", F.col("z") > ENTER, F.col("z") > LEAVE), ["signal"], 10, strict=True)


@query("union_length", "WITH iv AS (SELECT o_custkey AS k, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS start, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) + 30 AS stop FROM orders), m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY k ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM iv), r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM m), u AS (SELECT k, min(start) AS a, max(stop) AS b FROM r GROUP BY k, run) SELECT k AS o_custkey, sum(b - a)::BIGINT AS length FROM u GROUP BY k")
def union_length(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    iv = o.select("o_custkey", start.alias("start"), (start + 30).alias("stop"))
    return R.union_length(iv, ["o_custkey"]).withColumn("length", F.col("length").cast("long"))


FLAGS = f"{SCORED}, byframe AS (SELECT frame, bool_or(z > 2.0) AS enter, bool_or(z > 1.0) AS leave, count(*) FILTER (z > 1.0) AS n_enter FROM scored WHERE z IS NOT NULL GROUP BY frame)"
CANDS = f"{FLAGS}, ci AS (SELECT *, frame - row_number() OVER (ORDER BY frame) AS g FROM byframe WHERE leave), ch AS (SELECT min(frame) AS start, max(frame) + 1 AS stop FROM ci GROUP BY g HAVING bool_or(enter)), cm AS (SELECT *, CASE WHEN start - max(stop) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 3 THEN 0 ELSE 1 END AS new FROM ch), cr AS (SELECT *, sum(new) OVER (ORDER BY start) AS run FROM cm), spans AS (SELECT min(start) AS start, max(stop) AS stop FROM cr GROUP BY run HAVING max(stop) - min(start) >= 2)"
HITS = f"{CANDS}, pairs AS (SELECT s.start, s.stop, z.signal FROM spans s JOIN scored z ON z.frame >= s.start AND z.frame < s.stop AND z.z > 2.0 GROUP BY 1, 2, 3)"


@query("candidates", f"WITH {HITS} SELECT p.start AS start_frame, p.stop AS stop_frame, count(DISTINCT p.signal) AS n_pairs, string_agg(DISTINCT p.signal, '|' ORDER BY p.signal) AS signals, round(max(z.z), 6) AS peak_z FROM pairs p JOIN scored z ON z.signal = p.signal AND z.frame >= p.start AND z.frame < p.stop GROUP BY 1, 2")
def candidates_query(spark, sf):
    found = candidates(scored(spark, sf), DRIVER)
    return found.select(F.col("start").alias("start_frame"), F.col("stop").alias("stop_frame"), F.size("signals").cast("long").alias("n_pairs"), F.concat_ws("|", "signals").alias("signals"), F.round("peak_z", 6).alias("peak_z"))


@query("combine_k_of_n", f"WITH {FLAGS} SELECT frame, n_enter FROM byframe WHERE n_enter >= 2")
def combine_k_of_n(spark, sf):
    z = scored(spark, sf).where("z is not null")
    return z.groupBy("frame").agg(F.count_if(F.col("z") > LEAVE).alias("n_enter")).where("n_enter >= 2")


@query("flag_rates", f"WITH {SCORED}, d AS (SELECT count(DISTINCT frame) AS n FROM scored WHERE z IS NOT NULL), p AS (SELECT signal, count(*) FILTER (z > 2.0) AS k FROM scored WHERE z IS NOT NULL GROUP BY 1), u AS (SELECT count(DISTINCT frame) FILTER (z > 2.0) AS k FROM scored WHERE z IS NOT NULL), c AS (SELECT count(*) AS k FROM (SELECT frame FROM scored WHERE z > 2.0 GROUP BY frame HAVING count(*) >= 2)) SELECT signal AS scope, round(k / n::DOUBLE, 6) AS rate FROM p, d UNION ALL SELECT 'union', round(k / n::DOUBLE, 6) FROM u, d UNION ALL SELECT 'combined', round(k / n::DOUBLE, 6) FROM c, d")
def flag_rates(spark, sf):
    """Rates per signal, over any signal and over at least two, all over the frames with any score."""
    z = scored(spark, sf).where("z is not null").select("signal", "frame", (F.col("z") > ENTER).alias("flag"))
    by_signal = z.where("flag").groupBy("signal").agg(F.count("*").alias("k"))
    signals = z.select("signal").distinct().join(by_signal, "signal", "left").select(F.col("signal").alias("scope"), F.coalesce("k", F.lit(0)).alias("k"))
    by_frame = z.groupBy("frame").agg(F.count_if("flag").alias("m"))
    total = by_frame.agg(F.count("*").alias("n"), F.count_if(F.col("m") >= 1).alias("one"), F.count_if(F.col("m") >= 2).alias("two"))
    both = total.select(F.explode(F.create_map(F.lit("union"), F.col("one"), F.lit("combined"), F.col("two"))).alias("scope", "k"))
    n = total.select("n").scalar()
    return signals.unionByName(both).select("scope", F.round(ratio(F.col("k"), n), 6).alias("rate"))


CORES = f"{CANDS}, hot AS (SELECT s.start AS c_start, z.frame, z.signal, z.z FROM spans s JOIN scored z ON z.frame >= s.start AND z.frame < s.stop AND z.z > 2.0), hf AS (SELECT DISTINCT c_start, frame FROM hot), hg AS (SELECT *, frame - row_number() OVER (PARTITION BY c_start ORDER BY frame) AS g FROM hf), cores AS (SELECT c_start, min(frame) AS start, max(frame) + 1 AS stop FROM hg GROUP BY c_start, g)"


@query("cores", f"WITH {CORES}, j AS (SELECT c.*, h.signal, max(h.z) AS z FROM cores c JOIN hot h ON h.c_start = c.c_start AND h.frame >= c.start AND h.frame < c.stop GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY c_start, start ORDER BY z DESC, signal) AS r, count(*) OVER (PARTITION BY c_start, start) AS n FROM j) SELECT c_start AS candidate, start AS start_frame, stop AS stop_frame, n AS n_pairs, signal AS peak_signal, round(z, 6) AS peak_z FROM k WHERE r = 1")
def cores_query(spark, sf):
    z = scored(spark, sf)
    found = cores(z, candidates(z, DRIVER), ENTER)
    return found.select("candidate", F.col("start").alias("start_frame"), F.col("stop").alias("stop_frame"), "n_pairs", "peak_signal", F.round("peak_z", 6).alias("peak_z"))


FAST = "('click', 'view')"


@query("width_breakdown", f"WITH {CANDS}, f AS (SELECT s.start, s.stop, g.frame, coalesce(bool_or(z.z > 2.0 AND z.signal IN {FAST}), false) AS cf, coalesce(bool_or(z.z > 2.0), false) AS cs, coalesce(bool_or(z.z > 1.0 AND z.signal IN {FAST}), false) AS tf, coalesce(bool_or(z.z > 1.0), false) AS ts FROM spans s, LATERAL (SELECT unnest(generate_series(s.start, s.stop - 1)) AS frame) g LEFT JOIN scored z ON z.frame = g.frame GROUP BY 1, 2, 3) SELECT start AS start_frame, CASE WHEN cf THEN 'core_fast' WHEN cs THEN 'core_slow' WHEN tf THEN 'tail_fast' WHEN ts THEN 'tail_slow' ELSE 'merge_gap' END AS part, count(*) AS n FROM f GROUP BY 1, 2")
def width_breakdown(spark, sf):
    """Each frame of a candidate in exactly one part; signals in FAST stand for the fast bands."""
    z = scored(spark, sf)
    fast = F.col("signal").isin("click", "view")
    flags = z.groupBy("frame").agg(*(F.coalesce(F.max(c), F.lit(False)).alias(n) for n, c in (("cf", (F.col("z") > ENTER) & fast), ("cs", F.col("z") > ENTER), ("tf", (F.col("z") > LEAVE) & fast), ("ts", F.col("z") > LEAVE))))
    grid = candidates(z, DRIVER).select(F.col("start").alias("start_frame"), F.explode(F.sequence(F.col("start"), F.col("stop") - 1)).alias("frame"))
    part = F.when(F.col("cf"), "core_fast").when(F.col("cs"), "core_slow").when(F.col("tf"), "tail_fast").when(F.col("ts"), "tail_slow").otherwise("merge_gap")
    return grid.join(flags, "frame", "left").groupBy("start_frame", part.alias("part")).agg(F.count("*").alias("n"))


@query("assisted_entry", f"WITH {SCORED}, p AS (SELECT DISTINCT epoch_us(ts) // 3600000000 AS frame FROM events WHERE event_type = 'purchase' AND value > 100), e AS (SELECT signal, frame, z, z > 2.0 OR (z > 1.5 AND frame IN (SELECT frame FROM p)) AS enter FROM scored WHERE z > 1.0), g AS (SELECT *, frame - row_number() OVER (PARTITION BY signal ORDER BY frame) AS g FROM e) SELECT signal, min(frame) AS start, max(frame) + 1 AS stop, max(z) <= 2.0 AS assisted FROM g GROUP BY signal, g HAVING bool_or(enter)")
def assisted_entry(spark, sf):
    """A lower bar to enter in frames that another source marks; a run that only that bar let in is tagged."""
    from .base import events

    marks = events(spark, sf).where("event_type = 'purchase' and value > 100").select(F.expr("us div 3600000000").alias("frame")).distinct().withColumn("marked", F.lit(True))
    z = scored(spark, sf).join(marks, "frame", "left")
    enter = (F.col("z") > ENTER) | ((F.col("z") > 1.5) & F.col("marked"))
    found = R.hysteresis(z, ["signal"], "frame", enter, F.col("z") > LEAVE, top=F.max("z"))
    return found.select("signal", "start", "stop", (F.col("top") <= ENTER).alias("assisted"))


@query("stamp_windows", f"WITH {SCORED}, beats AS (SELECT DISTINCT epoch_us(ts) / 3600000000.0 AS t FROM events WHERE event_type = 'signup' AND value > 60), st AS (SELECT DISTINCT unnest(generate_series(floor(t - 0.5)::BIGINT, ceil(t + 0.5)::BIGINT)) AS frame FROM beats) SELECT signal, count(*) AS kept FROM scored WHERE z > 1.0 AND frame NOT IN (SELECT frame FROM st) GROUP BY 1")
def stamp_windows(spark, sf):
    """Frames over the exit level that no stamped window touches (from floor(lo) to ceil(hi) inclusive)."""
    from .base import events

    t = F.col("us") / 3600000000.0
    beats = events(spark, sf).where("event_type = 'signup' and value > 60").select(t.alias("t"))
    stamped = beats.select(F.explode(F.sequence(F.floor(F.col("t") - 0.5), F.ceil(F.col("t") + 0.5))).alias("frame")).distinct()
    return scored(spark, sf).where(F.col("z") > LEAVE).join(stamped, "frame", "left_anti").groupBy("signal").agg(F.count("*").alias("kept"))


EXT = f"{HYST}, ev AS (SELECT signal, frame AS id, frame - 2 AS start, frame + 3 AS stop FROM scored WHERE z > 2.0)"


@query("extent_join", f"WITH {EXT} SELECT e.signal, e.id, greatest(min(h.start) - 1, 0)::BIGINT AS start, (max(h.stop) + 1)::BIGINT AS stop, count(*) AS n_runs FROM ev e JOIN hyst h ON h.signal = e.signal AND h.start < e.stop AND h.stop > e.start GROUP BY 1, 2")
def extent_join(spark, sf):
    """From the first start to the last stop of the runs that overlap an event, padded by the settling frames."""
    z = scored(spark, sf)
    found = R.hysteresis(z, ["signal"], "frame", F.col("z") > ENTER, F.col("z") > LEAVE).select("signal", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    ev = z.where(F.col("z") > ENTER).select("signal", F.col("frame").alias("id"), (F.col("frame") - 2).alias("start"), (F.col("frame") + 3).alias("stop"))
    pairs = overlap_join(ev, found, ["signal"], 64)
    return pairs.groupBy("signal", "id").agg(F.greatest(F.min("r_start") - 1, F.lit(0)).alias("start"), (F.max("r_stop") + 1).alias("stop"), F.count("*").alias("n_runs"))


@query("detected_extent", f"WITH {EXT}, d AS (SELECT e.signal, e.id, min(h.start) AS start, max(h.stop) AS stop FROM ev e JOIN hyst h ON h.start < e.stop AND h.stop > e.start GROUP BY 1, 2) SELECT signal, id, start, stop FROM d")
def detected_extent(spark, sf):
    """The hull over the runs of all signals that overlap the event, whatever signal the event is of."""
    z = scored(spark, sf)
    found = R.hysteresis(z, ["signal"], "frame", F.col("z") > ENTER, F.col("z") > LEAVE).select(F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    ev = z.where(F.col("z") > ENTER).select("signal", F.col("frame").alias("id"), (F.col("frame") - 2).alias("start"), (F.col("frame") + 3).alias("stop"))
    return overlap_join(ev, found, [], 64).groupBy("signal", "id").agg(F.min("r_start").alias("start"), F.max("r_stop").alias("stop"))


@query("sparse_hull", f"WITH {CORES}, {ISLANDS.replace('flagged', '(SELECT signal, frame FROM scored WHERE z > 1.0)')}, r AS (SELECT signal, min(frame) AS start, max(frame) + 1 AS stop FROM g GROUP BY signal, g) SELECT r.* FROM r WHERE EXISTS (SELECT 1 FROM cores c WHERE c.start < r.stop AND c.stop > r.start)")
def sparse_hull(spark, sf):
    """Runs over the floor that overlap a core; the rest of the trace is not kept."""
    z = scored(spark, sf)
    over = R.true_runs(z.where(F.col("z") > LEAVE), ["signal"], "frame").withColumn("id", F.concat_ws("|", "signal", "start"))
    found = cores(z, candidates(z, DRIVER), ENTER).select(F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    return overlap_join(over, found, [], 64, "left_semi").drop("id")


@query("dilate", f"WITH {HYST}, w AS (SELECT signal, start - 4 AS start, stop + 4 AS stop FROM hyst), m AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY signal ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM w), r AS (SELECT *, sum(new) OVER (PARTITION BY signal ORDER BY start) AS run FROM m) SELECT signal, min(start) AS start, max(stop) AS stop FROM r GROUP BY signal, run")
def dilate(spark, sf):
    z = scored(spark, sf)
    wide = R.hysteresis(z, ["signal"], "frame", F.col("z") > ENTER, F.col("z") > LEAVE).select("signal", (F.col("start") - 4).alias("start"), (F.col("stop") + 4).alias("stop"))
    return R.merge_intervals(wide, ["signal"])


@query("complement_spans", f"WITH {MERGED}, b AS (SELECT signal, min(frame) AS lo, max(frame) + 1 AS hi FROM frames GROUP BY 1), x AS (SELECT b.signal, lo, hi, m.start, m.stop, lag(m.stop) OVER (PARTITION BY b.signal ORDER BY m.start) AS prev FROM b LEFT JOIN merged m USING (signal)), y AS (SELECT signal, coalesce(prev, lo) AS start, coalesce(start, hi) AS stop FROM x UNION ALL SELECT signal, max(stop), any_value(hi) FROM x WHERE stop IS NOT NULL GROUP BY signal) SELECT * FROM y WHERE start < stop")
def complement_spans(spark, sf):
    z = scored(spark, sf)
    bounds = z.groupBy("signal").agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi"))
    found = R.merge_intervals(R.hysteresis(z, ["signal"], "frame", F.col("z") > ENTER, F.col("z") > LEAVE), ["signal"], 10, strict=True)
    return R.complement(found, bounds, ["signal"])


@query("valid_segments", f"WITH {FRAMES}, flagged AS (SELECT signal, frame FROM frames), {ISLANDS} SELECT signal, min(frame) AS start, max(frame) + 1 AS stop, count(*) AS n FROM g GROUP BY signal, g HAVING count(*) >= 24")
def valid_segments(spark, sf):
    """Stretches without a missing frame that are long enough for a filter to settle."""
    found = R.true_runs(frames(spark, sf), ["signal"], "frame")
    return found.withColumn("n", F.col("stop") - F.col("start")).where("n >= 24")


@query("grid_convert", "SELECT event_id, (us // 10000)::BIGINT AS frame, ((us // 10000)::DOUBLE + 0.5) * 0.01::DOUBLE - 1700000000 AS centre, round_even(us * 1e-6 * 0.0244140625, 0)::BIGINT AS sample, ceil(us * 1e-6 * 0.0244140625 - 1e-6)::BIGINT AS first_sample FROM (SELECT event_id, epoch_us(ts) AS us FROM events)")
def grid_convert(spark, sf):
    """Times to the 10 ms grid and to a sampling rate: floor, half-even and ceiling with a tolerance."""
    from .base import events

    e = events(spark, sf).withColumn("frame", F.expr("us div 10000"))
    at = F.col("us") * 1e-6 * 0.0244140625
    return e.select("event_id", "frame", ((F.col("frame") + 0.5) * 0.01 - 1700000000).alias("centre"), half_even(at).alias("sample"), F.ceil(at - 1e-6).alias("first_sample"))


@query("persistent_run", f"WITH {FRAMES}, c AS (SELECT signal, frame, round_even(rms / 20, 0)::BIGINT AS code, row_number() OVER (PARTITION BY signal ORDER BY frame) AS i FROM frames), g AS (SELECT *, i - row_number() OVER (PARTITION BY signal, code ORDER BY i) AS g FROM c) SELECT signal, code, min(frame) AS start, count(*) AS n FROM g GROUP BY signal, code, g HAVING count(*) >= 3")
def persistent_run(spark, sf):
    """At least three consecutive rows on the same grid code."""
    by = Window.partitionBy("signal").orderBy("frame")
    coded = frames(spark, sf).select("signal", "frame", half_even(F.col("rms") / 20).alias("code")).withColumn("i", F.row_number().over(by))
    island = F.col("i") - F.row_number().over(Window.partitionBy("signal", "code").orderBy("i"))
    return coded.withColumn("g", island).groupBy("signal", "code", "g").agg(F.min("frame").alias("start"), F.count("*").alias("n")).where("n >= 3").drop("g")
