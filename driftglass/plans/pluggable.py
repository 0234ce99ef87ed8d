"""Queries of pluggable operators, guards and side channels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.functions.robust import log_envelope
from driftglass.operators import guards as G
from driftglass.operators import pluggable as L
from driftglass.operators.runs import true_runs
from driftglass.sources.shared import shared_folder, staged

from .base import FRAMES, LOGS, SCORED, events, frames, query, scored, table


@query(
    "cleaners",
    f"WITH {LOGS}, means AS (SELECT signal, frame % 24 AS phase, avg(x) AS m FROM logs GROUP BY 1, 2), c AS (SELECT 'none' AS cleaner, signal, frame, x FROM logs UNION ALL SELECT 'phase_mean', l.signal, frame, x - m FROM logs l JOIN means p ON l.signal = p.signal AND frame % 24 = phase"
    " UNION ALL SELECT 'comb', a.signal, a.frame, a.x - b.x FROM logs a LEFT JOIN logs b ON a.signal = b.signal AND a.frame = b.frame + 24) SELECT cleaner, signal, frame, round(x, 6) AS x FROM c",
)
def cleaners(spark, sf):
    """Frames under each cleaner of a daily rhythm."""
    x = frames(spark, sf).withColumn("x", log_envelope(F.col("rms")))
    out = L.clean(x, ["none", "phase_mean", "comb"], ["signal"], "frame", "x", 24)
    return out.withColumn("x", F.round("x", 6))


SPANS = f"{SCORED}, flagged AS (SELECT signal, frame, frame - row_number() OVER (PARTITION BY signal ORDER BY frame) AS g FROM scored WHERE abs(z) >= 1.5), spans AS (SELECT signal, min(frame) AS start, max(frame) + 1 AS stop FROM flagged GROUP BY signal, g)"
LOCAL = "near AS (SELECT s.signal, start, stop, frame, x, CASE WHEN frame < start OR frame >= stop THEN x END AS y FROM spans s JOIN scored f ON f.signal = s.signal AND frame >= start - 8 AND frame < stop + 8), w AS (SELECT *, lag(x) OVER e AS xa, lead(x) OVER e AS xb, lag(y) OVER e AS ya, lead(y) OVER e AS yb FROM near WINDOW e AS (PARTITION BY signal, start, stop ORDER BY frame)), beats AS (SELECT signal, start, stop, frame, frame >= start AND frame < stop AS inside, coalesce(x > coalesce(xa, x - 1) AND x > coalesce(xb, x - 1), false) AS a, coalesce(y > coalesce(ya, y - 1) AND y > coalesce(yb, y - 1), false) AS b FROM w)"
DAMAGE = f"WITH {SPANS}, {LOCAL}, d AS (SELECT signal, start, stop, count(*) FILTER (a AND NOT b AND NOT inside) AS lost, count(*) FILTER (b AND NOT a AND NOT inside) AS added, count(*) FILTER (a AND inside) AS n_inside FROM beats GROUP BY 1, 2, 3)"


def local_maxima(series, keys):
    """A frame above both neighbours; a missing neighbour is lower."""
    w = Window.partitionBy(*keys).orderBy("at")
    lower = lambda other: F.col("x") > F.coalesce(other.over(w), F.col("x") - 1)
    return series.withColumn("_top", lower(F.lag("x")) & lower(F.lead("x"))).where("_top").drop("_top")


def damage(spark, sf):
    z = scored(spark, sf)
    spans = true_runs(z.where("abs(z) >= 1.5").select("signal", "frame"), ["signal"], "frame")
    return L.operational_damage(z.select("signal", F.col("frame").alias("at"), "x"), spans, ["signal"], local_maxima, 8, 0.5, 0.0)


@query("operational_damage", f"{DAMAGE} SELECT signal, start, stop, lost, added, n_inside, lost > 0 OR added > 0 OR n_inside > 0 AS changed FROM d")
def operational_damage(spark, sf):
    """Whether the train of local maxima changes where frames far from the middle are suppressed."""
    return damage(spark, sf).drop("shift")


@query("peak_damage")
def peak_damage(spark, sf):
    """The same for peaks by prominence, which may move by two frames but count as changed if by more than one."""
    z = staged(scored(spark, sf), shared_folder(spark, "scored"), "frames")
    spans = true_runs(z.where("abs(z) >= 1.5").select("signal", "frame"), ["signal"], "frame")
    return L.operational_damage(z.select("signal", F.col("frame").alias("at"), "x"), spans, ["signal"], L.prominent(0.5, 3), 12, 2.0, 1.0)


@query("damage_extents", f"{DAMAGE}, b AS (SELECT min(frame) AS lo, max(frame) + 1 AS hi FROM frames) SELECT signal, start, stop, greatest(lo, start - 3) AS extent_start, least(hi, stop + 3) AS extent_stop FROM d, b WHERE lost > 0 OR added > 0 OR n_inside > 0")
def damage_extents(spark, sf):
    """Padded spans of the events that changed the train, inside the record."""
    bounds = frames(spark, sf).agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi"))
    found = L.damage_extent(damage(spark, sf), 3, bounds.select("lo").scalar(), bounds.select("hi").scalar())
    return found.select("signal", "start", "stop", "extent_start", "extent_stop")


FOUND = "now AS (SELECT user_id, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + 3600 AS stop FROM events WHERE event_type = 'purchase' AND value > 11), old AS (SELECT user_id, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + 3600 AS stop FROM events WHERE event_type = 'purchase' AND value > 10), marks AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'error')"
DIGEST = "count(*)::VARCHAR || ':' || sum(('0x' || substr(md5(start::VARCHAR || ':' || stop::VARCHAR), 1, 8))::BIGINT)::VARCHAR"


@query(
    "score_stored_round",
    f"WITH {FOUND}, spans AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, count(*) AS n_candidates, {DIGEST} AS digest FROM now GROUP BY 1), s AS (SELECT user_id, {DIGEST} AS shown FROM old GROUP BY 1), m AS (SELECT user_id, count(*) AS n_marks FROM marks GROUP BY 1), h AS (SELECT user_id, count(DISTINCT event_id) AS n_hit FROM marks JOIN now USING (user_id) WHERE t < stop AND t + 1 > start GROUP BY 1)"
    " SELECT user_id, CASE WHEN shown IS NULL THEN 'absent' WHEN shown IS NOT DISTINCT FROM digest THEN 'verified' ELSE 'differs' END AS state, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_marks, 0) AS n_marks, coalesce(n_hit, 0) AS n_hit, 'tuning' AS mode FROM spans LEFT JOIN n USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN m USING (user_id) LEFT JOIN h USING (user_id)",
)
def score_stored_round(spark, sf):
    """Errors of each user inside the hour after a purchase; the purchases shown were those above 10, now above 11."""
    e = events(spark, sf).withColumn("t", F.expr("us div 1000000"))

    def purchases(least):
        return e.where((F.col("event_type") == "purchase") & (F.col("value") > least)).select("user_id", F.col("t").alias("start"), (F.col("t") + 3600).alias("stop"))

    marks = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("mark"), F.col("t").alias("start"), (F.col("t") + 1).alias("stop"))
    shown = L.interval_digest(purchases(10), ["user_id"]).select("user_id", "digest")
    spans = e.select("user_id").distinct()
    return L.score_stored(spans, marks, shown, lambda s: purchases(11), ["user_id"], 7200, mode="tuning")


@query(
    "side_channels",
    f"WITH {FRAMES}, d AS (SELECT 'orders' AS channel, epoch_us(o_orderdate) // 86400000000 AS i, avg(o_totalprice) AS x, 1.0::DOUBLE / 86400 AS fs FROM orders GROUP BY 2), e AS (SELECT event_type AS channel, epoch_us(ts) // (CASE event_type WHEN 'click' THEN 3600000000 ELSE 21600000000 END) AS i, avg(value) AS x, 1.0::DOUBLE / any_value(CASE event_type WHEN 'click' THEN 3600 ELSE 21600 END) AS fs FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2), u AS (SELECT * FROM d UNION ALL SELECT * FROM e) SELECT channel, i, round(x, 6) AS x, round(fs, 9) AS fs, round(i / fs, 3) AS t FROM u",
)
def side_channels(spark, sf):
    """Channels of different rates in one table, each row with its own rate; never resampled."""

    def channel(rows, name, step_s, value):
        sampled = rows.groupBy(F.expr(f"us div {step_s * 1_000_000}").alias("i")).agg(F.avg(value).alias("x"))
        return sampled.select(F.lit(name).alias("channel"), "i", "x", F.lit(1 / step_s).alias("fs"))

    e = events(spark, sf)
    o = table(spark, sf, "orders").withColumn("us", F.expr("unix_micros(cast(o_orderdate as timestamp))"))
    parts = channel(o, "orders", 86_400, "o_totalprice").unionByName(channel(e.where("event_type = 'click'"), "click", 3600, "value")).unionByName(channel(e.where("event_type = 'purchase'"), "purchase", 21_600, "value"))
    return parts.select("channel", "i", F.round("x", 6).alias("x"), F.round("fs", 9).alias("fs"), F.round(F.col("i") / F.col("fs"), 3).alias("t"))


@query(
    "parameter_guard",
    "SELECT p_partkey, p_type, p_size, CASE WHEN p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') OR p_type IS NULL THEN 'undeclared' WHEN p_size IS NULL THEN 'missing' WHEN p_size < CASE p_type WHEN 'ECONOMY' THEN 5 ELSE 1 END THEN 'below' WHEN p_size > CASE p_type WHEN 'ECONOMY' THEN 40 WHEN 'STANDARD' THEN 25 ELSE 50 END THEN 'above' ELSE 'ok' END AS verdict FROM part",
)
def parameter_guard(spark, sf):
    """Values against the declared range of their name."""
    ranges = {"ECONOMY": (5, 40), "STANDARD": (1, 25), "PROMO": (1, 50)}
    return table(spark, sf, "part").select("p_partkey", "p_type", "p_size", G.declared(F.col("p_type"), F.col("p_size"), ranges).alias("verdict"))


PLACE = "regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '')"


@query(
    "tolerance_table_use",
    f"WITH p AS (SELECT page_id, {PLACE} AS root, regexp_replace({PLACE}, '^[a-z]+://[^/]*', '') AS path, contains(url, '?') AS flagged FROM pages) SELECT page_id, path, CASE WHEN path LIKE '/es/%' OR path LIKE '/de/%' THEN CASE WHEN flagged THEN 'refused: not the stand-in' WHEN NOT (path = '/es' OR path LIKE '/es/%') OR regexp_matches(path, '(^|/)\\.\\.(/|$)') THEN 'refused: outside the pilot folder' ELSE 'stand_in' END WHEN path LIKE '/en/%' AND NOT flagged THEN 'production' ELSE 'refused: not the gate''s output' END AS use FROM p",
)
def tolerance_table_use(spark, sf):
    """Where a table may be used: stand-ins (es, de) only below /es and without parameters, gate tables (en) anywhere."""
    place = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/+$", "")
    path = F.regexp_replace(place, "^[a-z]+://[^/]*", "")
    rows = table(spark, sf, "pages").select("page_id", path.alias("path"), F.col("url").contains("?").alias("flagged"))
    lang = lambda x: F.col("path").startswith(f"/{x}/")
    use = G.table_use(lang("es") | lang("de"), ~F.col("flagged"), lang("en"), F.col("flagged"), F.col("path"), "/es")
    return rows.select("page_id", "path", use.alias("use"))


@query(
    "optional_fields",
    "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'absent' WHEN try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 'malformed' ELSE 'read' END AS k_state, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'absent' WHEN try_cast(json_extract_string(props, '$.k') AS BOOLEAN) IS NULL THEN 'malformed' ELSE 'read' END AS flag_state, CASE WHEN json_extract_string(props, '$.gap_after') IS NULL THEN 'absent' ELSE 'read' END AS gap_state FROM events",
)
def optional_fields(spark, sf):
    """Fields that a record may lack, read as a declared type."""
    k, k_state = G.optional(F.col("props"), "k", "int")
    state = {f"{n}_state": G.optional(F.col("props"), f, t)[1] for n, f, t in (("flag", "k", "boolean"), ("gap", "gap_after", "double"))}
    return table(spark, sf, "events").select("event_id", k.alias("k"), k_state.alias("k_state"), *(c.alias(n) for n, c in state.items()))


@query(
    "exclusion_lookup",
    "WITH c AS (SELECT n_name AS host, c_mktsegment AS consumer, floor(c_acctbal / 1000)::BIGINT AS bracket, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3), g AS (SELECT *, unnest(range(1, 1 + CASE consumer WHEN 'MACHINERY' THEN 3 ELSE 2 END)) AS seed FROM c) SELECT host || '|' || consumer || '|' || bracket || '|' || seed AS key, n, CASE WHEN host = (SELECT min(n_name) FROM nation) AND consumer = 'FURNITURE' THEN 'no reference' WHEN consumer = 'AUTOMOBILE' THEN 'short record' END AS reason FROM g",
)
def exclusion_lookup(spark, sf):
    """Composite keys of host, consumer, bracket and seed, with the reason where a host is left out."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    first = n.agg(F.min("n_name")).scalar()
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("host"), F.col("c_mktsegment").alias("consumer"), F.floor(F.col("c_acctbal") / 1000).alias("bracket")).agg(F.count("*").alias("n"))
    seeds = F.sequence(F.lit(1), F.when(F.col("consumer") == "MACHINERY", 3).otherwise(2))
    grid = rows.withColumn("seed", F.explode(seeds)).withColumn("own", F.when(F.col("host") == first, "first").otherwise("other"))
    reason = F.coalesce(G.lookup([F.col("own"), F.col("consumer")], {("first", "FURNITURE"): "no reference"}), G.lookup([F.col("consumer")], {("AUTOMOBILE",): "short record"}))
    return grid.select(F.concat_ws("|", "host", "consumer", "bracket", "seed").alias("key"), "n", reason.alias("reason"))
