"""Scans, catalogs, rules, versioned tables, keys and records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftglass.functions import text as X
from driftglass.functions.robust import half_even, ratio
from driftglass.operators import rules as P
from driftglass.operators import versions as V

from .base import events, query, table
from .detection import rounded


@query("scan_events", "SELECT event_type, count(*) AS n, count(value) AS n_values, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, round(sum(value), 6) AS total FROM events GROUP BY 1")
def scan_events(spark, sf):
    e = events(spark, sf)
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("value").alias("total")), "total")


@query("interval_convert", "SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b, (min(l_linenumber) - 1) / 24.4140625::DOUBLE AS start, max(l_linenumber) / 24.4140625::DOUBLE AS stop FROM lineitem GROUP BY 1")
def interval_convert(spark, sf):
    """1-based inclusive sample pairs to 0-based half-open seconds."""
    pairs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return pairs.withColumns({"start": (F.col("a") - 1) / 24.4140625, "stop": F.col("b") / 24.4140625})


@query("label_parse", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^ECON') THEN 'tripole' WHEN regexp_matches(p_type, 'RD$') THEN 'raw' END AS role, regexp_extract(p_brand, '#([0-9]+)', 1)::INTEGER AS cuff, CASE WHEN p_size % 4 = 0 THEN NULL ELSE (p_size % 4)::INTEGER END AS contact FROM part")
def label_parse(spark, sf):
    """Labels to role, cuff and contact; what a label does not say is null."""
    role = F.when(F.col("p_type").rlike("^ECON"), "tripole").when(F.col("p_type").rlike("RD$"), "raw")
    return table(spark, sf, "part").select("p_partkey", role.alias("role"), F.regexp_extract("p_brand", "#([0-9]+)", 1).cast("int").alias("cuff"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 4).alias("contact"))


@query("unit_guard", "WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS c FROM events GROUP BY 1), s AS (SELECT event_type, 1.4826 * quantile_cont(abs(value - c), 0.5) AS sigma FROM events JOIN m USING (event_type) GROUP BY 1) SELECT event_type, round(sigma, 6) AS sigma, sigma > 1 AND sigma < 500 AS plausible FROM s")
def unit_guard(spark, sf):
    """A robust sigma outside (1, 500) means wrong units."""
    from driftglass.functions.robust import reference

    s = reference(events(spark, sf), ["event_type"], "value", 1).select("event_type", F.col("scale").alias("sigma"))
    return rounded(s.withColumn("plausible", (F.col("sigma") > 1) & (F.col("sigma") < 500)), "sigma")


@query("geometry_precedence", "SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_discount = 0 THEN 'explicit' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'session' END, CASE WHEN s_nationkey % 2 = 0 THEN 'profile' END, 'none') AS source FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey")
def geometry_precedence(spark, sf):
    """Explicit, then session, then profile."""
    o, s = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    rows = table(spark, sf, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(s, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    first = F.coalesce(F.when(F.col("l_discount") == 0, "explicit"), F.when(F.col("o_orderpriority") == "1-URGENT", "session"), F.when(F.col("s_nationkey") % 2 == 0, "profile"), F.lit("none"))
    return rows.select("l_orderkey", "l_linenumber", first.alias("source"))


SEEN = "h AS (SELECT doc_id, source, n_chars, sha256(text) AS k FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM h)"


@query("scan_status", f"WITH {SEEN} SELECT doc_id, CASE WHEN f.first < doc_id THEN 'duplicate' WHEN quality IS NOT NULL THEN 'known' ELSE 'new' END AS status, CASE WHEN f.first < doc_id THEN f.first END AS pointer FROM f LEFT JOIN labels USING (doc_id)")
def scan_status(spark, sf):
    """A content seen before in order is a duplicate with a pointer to the first; then known rows; then new ones."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("k"))
    first = d.groupBy("k").agg(F.min("doc_id").alias("first"))
    rows = d.join(first, "k").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    again = F.col("first") < F.col("doc_id")
    return rows.select("doc_id", F.when(again, "duplicate").when(F.col("quality").isNotNull(), "known").otherwise("new").alias("status"), F.when(again, F.col("first")).alias("pointer"))


@query("dup_by_size_then_hash", "WITH s AS (SELECT doc_id, n_chars, CASE WHEN count(*) OVER (PARTITION BY n_chars) > 1 THEN sha256(text) END AS k FROM documents) SELECT k, count(*) AS n, min(doc_id) AS first FROM s WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_by_size_then_hash(spark, sf):
    """Hashes only the rows whose size another row shares."""
    return V.duplicates(table(spark, sf, "documents"), "doc_id", "n_chars", "text")


@query("human_override", "SELECT doc_id, coalesce(CASE WHEN quality = 0 THEN 'human:reject' END, CASE WHEN n_chars < 300 THEN 'rule:short' END, 'rule:ok') AS label, quality IS NOT NULL AS has_human FROM documents LEFT JOIN labels USING (doc_id)")
def human_override(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    label = F.coalesce(F.when(F.col("quality") == 0, "human:reject"), F.when(F.col("n_chars") < 300, "rule:short"), F.lit("rule:ok"))
    return rows.select("doc_id", label.alias("label"), F.col("quality").isNotNull().alias("has_human"))


@query("scope_filter", "SELECT count(*) AS n, count(*) FILTER (starts_with(url, 'https://') OR starts_with(url, 'http://m.')) AS inside FROM pages")
def scope_filter(spark, sf):
    inside = X.under_any(F.col("url"), ["https://", "http://m."])
    return table(spark, sf, "pages").agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))


@query("manifest_check", "WITH m AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 70 <> 1), l AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 90 <> 2) SELECT coalesce(m.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'unlisted' ELSE 'size' END AS reason FROM m FULL JOIN l ON m.doc_id = l.doc_id WHERE l.doc_id IS NULL OR m.doc_id IS NULL OR m.size <> l.n_chars")
def manifest_check(spark, sf):
    """A manifest against a listing: missing, unlisted, or of another size."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    manifest = d.where("doc_id % 70 <> 1").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)).alias("size"))
    return V.check_manifest(manifest, d.where("doc_id % 90 <> 2").withColumnRenamed("n_chars", "size"), "doc_id", "size")


@query("session_key", "SELECT event_id, user_id || '@' || strftime(ts, '%Y%m%dT%H%M%SZ') AS key, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS local_date FROM events")
def session_key(spark, sf):
    ts = F.col("ts").cast("timestamp")
    local = F.date_format(F.from_utc_timestamp(ts, "Asia/Tokyo"), "yyyy-MM-dd")
    return events(spark, sf).select("event_id", F.concat_ws("@", F.col("user_id").cast("string"), X.utc_stamp(ts)).alias("key"), local.alias("local_date"))


@query("utc_stamp", "SELECT event_type, min(strftime(ts, '%Y%m%dT%H%M%SZ')) AS first, max(strftime(ts, '%Y%m%dT%H%M%SZ')) AS last FROM events GROUP BY 1")
def utc_stamp(spark, sf):
    stamp = X.utc_stamp(F.col("ts").cast("timestamp"))
    return events(spark, sf).groupBy("event_type").agg(F.min(stamp).alias("first"), F.max(stamp).alias("last"))


@query("eligible_antijoin", "SELECT d.doc_id, lang, source FROM documents d WHERE n_chars >= 500 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)")
def eligible_antijoin(spark, sf):
    bad = table(spark, sf, "labels").where("quality = 0").select("doc_id")
    return table(spark, sf, "documents").where("n_chars >= 500").select("doc_id", "lang", "source").join(bad, "doc_id", "left_anti")


@query("interval_difference", "WITH iv AS (SELECT l_orderkey, min(l_linenumber)::DOUBLE AS a, max(l_linenumber) + 1.0::DOUBLE AS b, min(l_quantity) / 10 AS x, max(l_quantity) / 10 AS y FROM lineitem GROUP BY 1) SELECT l_orderkey, a AS start, least(b, greatest(a, x)) AS stop FROM iv WHERE least(b, greatest(a, x)) > a UNION ALL SELECT l_orderkey, greatest(a, least(b, y)), b FROM iv WHERE b > greatest(a, least(b, y)) AND greatest(a, least(b, y)) > a")
def interval_difference(spark, sf):
    """What is left of a span without another: none, one or two pieces."""
    q = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").cast("double").alias("a"), (F.max("l_linenumber") + 1.0).alias("b"), (F.min("l_quantity") / 10).alias("x"), (F.max("l_quantity") / 10).alias("y"))
    left = F.struct(F.col("a").alias("start"), F.least("b", F.greatest("a", "x")).alias("stop"))
    right = F.struct(F.greatest("a", F.least("b", "y")).alias("start"), F.col("b").alias("stop"))
    pieces = F.filter(F.array(left, F.when(F.greatest("a", F.least("b", "y")) > F.col("a"), right)), lambda p: p["stop"] > p["start"])
    return q.select("l_orderkey", F.inline(pieces))


@query("label_split", "WITH s AS (SELECT o_orderkey, count(*) AS n, max(l_quantity) AS top, sum(l_quantity) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT CASE WHEN top > 0.9 * total THEN 'exclusion' ELSE 'event' END AS kind, count(*) AS n, sum(n)::BIGINT AS lines FROM s GROUP BY 1")
def label_split(spark, sf):
    """A label over nine tenths of its epoch excludes the epoch."""
    s = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("top"), F.sum("l_quantity").alias("total"))
    s = s.join(table(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    kind = F.when(F.col("top") > 0.9 * F.col("total"), "exclusion").otherwise("event")
    return s.groupBy(kind.alias("kind")).agg(F.count("*").alias("c"), F.sum("n").alias("lines")).withColumnRenamed("c", "n")


@query("beats_roundtrip", "WITH t AS (SELECT event_id, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS s FROM events), k AS (SELECT event_id, s, round_even(s * 24.4140625::DOUBLE, 0)::BIGINT + 1 AS sample FROM t) SELECT event_id, sample, round((sample - 1) / 24.4140625::DOUBLE, 6) AS back, abs((sample - 1) / 24.4140625::DOUBLE - s) <= 0.5 / 24.4140625::DOUBLE + 1e-9 AS exact FROM k")
def beats_roundtrip(spark, sf):
    """Seconds to 1-based samples and back, within half a sample."""
    s = ((F.col("us") - 1704067200000000) / 1e6).alias("s")
    k = events(spark, sf).select("event_id", s).withColumn("sample", half_even(F.col("s") * 24.4140625) + 1)
    back = (F.col("sample") - 1) / 24.4140625
    return k.select("event_id", "sample", F.round(back, 6).alias("back"), (F.abs(back - F.col("s")) <= 0.5 / 24.4140625 + 1e-9).alias("exact"))


WORDS = ", ".join(f"sum(('0x' || substr(k, {1 + 15 * i}, 15))::BIGINT)::VARCHAR" for i in range(4))


@query("content_digest", f"WITH d AS (SELECT lang, source, sha256(text) AS k FROM documents) SELECT lang, source, count(*) AS n, sha256(concat_ws(',', {WORDS})) AS digest FROM d GROUP BY 1, 2")
def content_digest(spark, sf):
    """A group's digest from its content hashes, whatever the order of the rows."""
    k = F.sha2(F.col("text").cast("binary"), 256)
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), V.multiset_digest(k).alias("digest"))


@query("reconcile_buckets", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal >= 0) SELECT CASE WHEN a.o_custkey IS NULL THEN 'planned only' WHEN b.c_custkey IS NULL THEN 'found only' WHEN n > 15 THEN 'collision' ELSE 'match' END AS bucket, count(*) AS n FROM a FULL JOIN b ON a.o_custkey = b.c_custkey GROUP BY 1")
def reconcile_buckets(spark, sf):
    a = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = table(spark, sf, "customer").where("c_acctbal >= 0").select("c_custkey")
    both = a.join(b, F.col("o_custkey") == F.col("c_custkey"), "full")
    bucket = F.when(F.col("o_custkey").isNull(), "planned only").when(F.col("c_custkey").isNull(), "found only").when(F.col("n") > 15, "collision").otherwise("match")
    return both.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("derive_columns", "SELECT event_id, round(0.5 * value + 0.5 * json_extract(props, '$.k')::INTEGER - user_id, 6) AS derived, round(value * 1e6, 3) AS micro FROM events")
def derive_columns(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return events(spark, sf).select("event_id", F.round(0.5 * F.col("value") + 0.5 * k - F.col("user_id"), 6).alias("derived"), F.round(F.col("value") * 1e6, 3).alias("micro"))


RULES = [("r1", 1, "spam", "block"), ("r2", 2, "^https", "secure"), ("r3", 2, "^http:", "plain"), ("r4", 3, "/en/", "english"), ("r5", 2, "html$", "page")]


@query("rule_classify", "WITH r(rule_id, priority, pattern, outcome) AS (VALUES ('r1', 1, 'spam', 'block'), ('r2', 2, '^https', 'secure'), ('r3', 2, '^http:', 'plain'), ('r4', 3, '/en/', 'english'), ('r5', 2, 'html$', 'page')), m AS (SELECT page_id, rule_id, priority, outcome, min(priority) OVER (PARTITION BY page_id) AS best FROM pages, r WHERE regexp_matches(regexp_replace(url, '#top$', ''), pattern)) SELECT page_id, CASE WHEN count(DISTINCT outcome) > 1 THEN 'ambiguous' ELSE min(outcome) END AS outcome, min(rule_id) AS rule_id FROM m WHERE priority = best GROUP BY 1")
def rule_classify(spark, sf):
    """Strips a suffix, then the rules of the best priority decide; more than one outcome there is ambiguous."""
    return P.classify(table(spark, sf, "pages").select("page_id", "url"), "url", RULES, ["#top"]).where("outcome is not null").select("page_id", "outcome", "rule_id")


@query("vocab_check", "SELECT lang, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'de', 'fr') GROUP BY 1")
def vocab_check(spark, sf):
    """Values outside a closed vocabulary, with their counts."""
    return P.outside(table(spark, sf, "documents"), "lang", ["en", "de", "fr"])


@query("struct_json", "SELECT doc_id, '{\"lang\":\"' || lang || '\"' || coalesce(',\"quality\":' || quality, '') || '}' AS j, quality::INTEGER AS back FROM documents LEFT JOIN labels USING (doc_id)")
def struct_json(spark, sf):
    """A struct to JSON and back; what is absent is left out, not written as null."""
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    j = rows.withColumn("j", F.to_json(F.struct("lang", "quality")))
    return j.select("doc_id", "j", F.from_json("j", "lang string, quality int")["quality"].alias("back"))


@query("quality_flags", "SELECT page_id, array_to_string(regexp_extract_all(url, '[?&]([a-z_]+)=', 1), '|') AS flags, regexp_extract(url, '//([^/]*)/([a-z]{2})/', 2) AS lang FROM pages")
def quality_flags(spark, sf):
    flags = F.array_join(F.regexp_extract_all("url", F.lit("[?&]([a-z_]+)="), 1), "|")
    return table(spark, sf, "pages").select("page_id", flags.alias("flags"), F.regexp_extract("url", "//([^/]*)/([a-z]{2})/", 2).alias("lang"))


@query("duration_verdict", "SELECT doc_id, CASE WHEN n_chars >= bar THEN 'ok' WHEN n_chars >= 0.9 * bar THEN 'borderline' ELSE 'short' END AS verdict FROM (SELECT *, CASE WHEN lang = 'en' THEN 1500 ELSE 1200 END AS bar FROM documents)")
def duration_verdict(spark, sf):
    bar = F.when(F.col("lang") == "en", 1500).otherwise(1200)
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") >= bar, "ok").when(F.col("n_chars") >= 0.9 * bar, "borderline").otherwise("short").alias("verdict"))


@query("split_status", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'refused' WHEN o_orderstatus = 'P' THEN 'manual' WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'auto' ELSE 'none' END AS status FROM orders")
def split_status(spark, sf):
    """Decision table, first match wins."""
    p = F.col("o_orderstatus") == "P"
    urgent = F.col("o_orderpriority").rlike("^[12]")
    return table(spark, sf, "orders").select("o_orderkey", F.when(p & (F.col("o_totalprice") > 200000), "refused").when(p, "manual").when(urgent, "auto").otherwise("none").alias("status"))


@query("reason_array", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_nationkey % 5 = 0 THEN 'region' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END) AS reasons FROM customer")
def reason_array(spark, sf):
    reasons = P.reasons({"negative": F.col("c_acctbal") < 0, "region": F.col("c_nationkey") % 5 == 0, "segment": F.col("c_mktsegment") == "BUILDING"})
    return table(spark, sf, "customer").select("c_custkey", F.array_join(reasons, ",").alias("reasons"))


@query("deny_list", "WITH deny AS (SELECT doc_id, quality FROM labels WHERE quality = 0) SELECT d.doc_id, CASE WHEN deny.doc_id IS NOT NULL THEN 'denied' WHEN source = 'src0' THEN 'source' ELSE 'trusted' END AS trust FROM documents d LEFT JOIN deny USING (doc_id)")
def deny_list(spark, sf):
    deny = table(spark, sf, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("denied"))
    rows = table(spark, sf, "documents").select("doc_id", "source").join(deny, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("denied"), "denied").when(F.col("source") == "src0", "source").otherwise("trusted").alias("trust"))


@query("two_threshold", "SELECT event_type, count(*) FILTER (value > 50 AND json_extract(props, '$.k')::INTEGER > 50) AS n FROM events GROUP BY 1")
def two_threshold(spark, sf):
    """Both levels exceeded; a missing value is no."""
    both = F.coalesce((F.col("value") > 50) & (F.get_json_object("props", "$.k").cast("int") > 50), F.lit(False))
    return events(spark, sf).groupBy("event_type").agg(F.count_if(both).alias("n"))


@query("confirm_filter", "WITH d AS (SELECT doc_id, quality, least(n_chars / 4000.0::DOUBLE, 1.0::DOUBLE) AS p FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, CASE WHEN quality IS NOT NULL THEN 'human' ELSE 'model' END AS origin FROM d WHERE CASE WHEN quality IS NOT NULL THEN quality = 0 ELSE p > 0.8 END")
def confirm_filter(spark, sf):
    """A human judgement counts as it is; a model's needs a score above the bar."""
    rows = table(spark, sf, "documents").select("doc_id", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("p")).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    human = F.col("quality").isNotNull()
    return rows.where(F.when(human, F.col("quality") == 0).otherwise(F.col("p") > 0.8)).select("doc_id", F.when(human, "human").otherwise("model").alias("origin"))


@query("training_filter", "WITH ok AS (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 30) SELECT l.doc_id, (quality = 0)::INTEGER AS y FROM labels l JOIN documents d USING (doc_id) WHERE source IN (SELECT source FROM ok) AND lang IN ('en', 'de') AND l.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def training_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    large = d.groupBy("source").agg(F.count("*").alias("n")).where("n >= 30").select("source")
    labels = table(spark, sf, "labels")
    toxic = labels.where("toxic = 1").select("doc_id")
    kept = labels.join(d.where("lang in ('en', 'de')").join(large, "source", "left_semi"), "doc_id").join(toxic, "doc_id", "left_anti")
    return kept.select("doc_id", (F.col("quality") == 0).cast("int").alias("y"))


@query("guard_zero_rows", "SELECT 'orders without customer' AS guard, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'negative quantity', count(*) FROM lineitem WHERE l_quantity < 0 UNION ALL SELECT 'lines without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def guard_zero_rows(spark, sf):
    """Guards that must find nothing."""
    o, l, c = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    found = {
        "orders without customer": o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "negative quantity": l.where("l_quantity < 0"),
        "lines without order": l.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
    }
    return V.guards(found)


@query("log_union_distinct", "WITH a AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events WHERE event_type <> 'click' UNION SELECT event_id, user_id, event_type, epoch_us(ts) FROM events WHERE event_type IN ('click', 'view')) SELECT event_type, count(*) AS n, min(us) AS first_us FROM a GROUP BY 1")
def log_union_distinct(spark, sf):
    """Shards of a log united, rows that several shards hold once."""
    e = events(spark, sf).select("event_id", "user_id", "event_type", "us")
    return V.union_log([e.where("event_type <> 'click'"), e.where("event_type IN ('click', 'view')")], ["event_id", "user_id", "event_type", "us"]).groupBy("event_type").agg(F.count("*").alias("n"), F.min("us").alias("first_us"))


NEWER = "o AS (SELECT c_custkey AS k, c_name || '|' || c_mktsegment AS v FROM customer WHERE c_mktsegment <> 'AUTOMOBILE' OR c_acctbal < 0), n AS (SELECT c_custkey AS k, c_name || '|' || CASE WHEN c_acctbal > 9000 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_mktsegment = 'AUTOMOBILE' OR c_acctbal >= 0)"


@query("table_diff", f"WITH {NEWER} SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.v IS DISTINCT FROM n.v")
def table_diff(spark, sf):
    """Keys added, removed or changed between two versions, by the hash of their entries."""
    c = table(spark, sf, "customer")
    entry = lambda seg: F.concat_ws("|", "c_name", seg)
    old = c.where("c_mktsegment <> 'AUTOMOBILE' OR c_acctbal < 0").select(F.col("c_custkey").alias("k"), entry("c_mktsegment").alias("v"))
    new = c.where("c_mktsegment = 'AUTOMOBILE' OR c_acctbal >= 0").select(F.col("c_custkey").alias("k"), entry(F.when(F.col("c_acctbal") > 9000, "NEW").otherwise(F.col("c_mktsegment"))).alias("v"))
    return V.diff(old, new, "k", ["v"]).select("k", "change")


@query("record_diff", f"WITH {NEWER} SELECT count(*) FILTER (o.v = n.v) AS same, count(*) FILTER (o.v IS DISTINCT FROM n.v) AS differ FROM o FULL JOIN n ON o.k = n.k")
def record_diff(spark, sf):
    c = table(spark, sf, "customer")
    old = c.where("c_mktsegment <> 'AUTOMOBILE' OR c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.concat_ws("|", "c_name", "c_mktsegment").alias("a"))
    new = c.where("c_mktsegment = 'AUTOMOBILE' OR c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.concat_ws("|", "c_name", F.when(F.col("c_acctbal") > 9000, "NEW").otherwise(F.col("c_mktsegment"))).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return old.join(new, "k", "full").agg(F.count_if(same).alias("same"), F.count_if(~same).alias("differ"))


@query("row_hash", "SELECT s_suppkey, sha256('{\"s_acctbal\":' || s_acctbal || ',\"s_name\":\"' || s_name || '\"}') AS h FROM supplier")
def row_hash(spark, sf):
    """Content hash of a row as canonical JSON, fields in order."""
    return table(spark, sf, "supplier").select("s_suppkey", V.row_hash(["s_name", "s_acctbal"]).alias("h"))


@query("set_validation", "WITH s AS (SELECT user_id, list(DISTINCT event_type) AS a FROM events GROUP BY 1) SELECT user_id, array_to_string(list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(a, x))), '|') AS missing, list_contains(a, 'purchase') AS buys FROM s")
def set_validation(spark, sf):
    s = events(spark, sf).groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    full = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    return s.select("user_id", F.array_join(F.sort_array(F.array_except(full, "a")), "|").alias("missing"), F.array_contains("a", "purchase").alias("buys"))


@query("signal_families", "WITH m AS (SELECT DISTINCT p_type AS derived, p_brand AS member FROM part WHERE p_size <= 2) SELECT derived, string_agg(member, '|' ORDER BY member) AS members, count(*) AS n FROM m GROUP BY 1")
def signal_families(spark, sf):
    """A derived signal and every member it is computed from."""
    m = table(spark, sf, "part").where("p_size <= 2").groupBy(F.col("p_type").alias("derived")).agg(F.sort_array(F.collect_set("p_brand")).alias("m"))
    return m.select("derived", F.array_join("m", "|").alias("members"), F.size("m").cast("long").alias("n"))


@query("coverage_except", "SELECT 'missing' AS side, n_name AS name FROM (SELECT n_name FROM nation EXCEPT SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)) UNION ALL SELECT 'extra', n_name FROM (SELECT n_name FROM nation WHERE n_nationkey % 3 = 0 EXCEPT SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)")
def coverage_except(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier").where("s_acctbal > 9000")
    have = n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("n_name")
    missing = n.select("n_name").exceptAll(have).distinct()
    extra = n.where("n_nationkey % 3 = 0").select("n_name").subtract(n.where("n_nationkey % 2 = 0").select("n_name"))
    return missing.select(F.lit("missing").alias("side"), F.col("n_name").alias("name")).union(extra.select(F.lit("extra"), "n_name"))


@query("declaration_check", "WITH want AS (SELECT n_nationkey AS k FROM nation), have AS (SELECT s_nationkey AS k, count(*) AS n, bool_and(s_acctbal > -900) AS ok FROM supplier GROUP BY 1) SELECT want.k, CASE WHEN have.k IS NULL THEN 'not declared' WHEN n > 1 THEN 'declared twice' WHEN NOT ok THEN 'out of range' ELSE 'ok' END AS verdict FROM want LEFT JOIN have USING (k)")
def declaration_check(spark, sf):
    """Every key declared once, with a value in range; nothing is defaulted."""
    have = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"), F.bool_and(F.col("s_acctbal") > -900).alias("ok"))
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).join(have, "k", "left")
    return rows.select("k", F.when(F.col("n").isNull(), "not declared").when(F.col("n") > 1, "declared twice").when(~F.col("ok"), "out of range").otherwise("ok").alias("verdict"))


@query("safe_component", "SELECT p_partkey, regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, regexp_matches(p_name, '^[a-z]+$') AS valid FROM part")
def safe_component(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.safe_component(F.concat_ws("/", "p_name", "p_type")).alias("safe"), F.col("p_name").rlike("^[a-z]+$").alias("valid"))


@query("token_roundtrip", "SELECT p_partkey, replace(replace(p_brand, '_', '__'), '#', '_h') AS token, replace(replace(replace(replace(replace(p_brand, '_', '__'), '#', '_h'), '__', chr(1)), '_h', '#'), chr(1), '_') = p_brand AS exact FROM part")
def token_roundtrip(spark, sf):
    token = X.to_token(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", token.alias("token"), (X.from_token(token) == F.col("p_brand")).alias("exact"))


@query("corpus_hash", f"SELECT lang, sha256(concat_ws(',', {WORDS})) AS h, count(*) AS n FROM (SELECT lang, sha256(source || ':' || printf('%.6f', doc_id / 7.0::DOUBLE)) AS k FROM documents) GROUP BY 1")
def corpus_hash(spark, sf):
    """Ids with times to the microsecond, and a hash of the set, whatever its order."""
    ids = F.concat_ws(":", "source", F.format_string("%.6f", F.col("doc_id") / 7.0))
    return table(spark, sf, "documents").groupBy("lang").agg(V.multiset_digest(F.sha2(ids.cast("binary"), 256)).alias("h"), F.count("*").alias("n"))


@query("provenance_json", "SELECT s_suppkey, '{' || CASE WHEN s_acctbal > 0 THEN '\"balance\":\"yes\",' ELSE '' END || '\"name\":\"' || s_name || '\",\"nation\":' || s_nationkey || '}' AS doc FROM supplier")
def provenance_json(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.to_json(F.struct(F.when(F.col("s_acctbal") > 0, "yes").alias("balance"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))).alias("doc"))


@query("abs_path_scan", "SELECT count(*) AS n, count(*) FILTER (regexp_matches(html, 'href=\"/[a-z]')) AS absolute FROM pages")
def abs_path_scan(spark, sf):
    return table(spark, sf, "pages").agg(F.count("*").alias("n"), F.count_if(F.col("html").rlike('href="/[a-z]')).alias("absolute"))


@query("key_builder", "SELECT l_orderkey, l_linenumber, l_returnflag || '/' || lpad(l_linenumber::VARCHAR, 3, '0') || '-' || l_orderkey AS key FROM lineitem")
def key_builder(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_returnflag"), F.lit("/"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit("-"), F.col("l_orderkey").cast("string")).alias("key"))


@query("key_parse", "SELECT c_custkey, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2)::BIGINT AS number, least(greatest((c_custkey // 60) * 60, 30), 1200) AS lo FROM customer")
def key_parse(spark, sf):
    part = lambda i: F.split_part("c_name", F.lit("#"), F.lit(i))
    return table(spark, sf, "customer").select("c_custkey", part(1).alias("kind"), part(2).cast("long").alias("number"), F.least(F.greatest(F.expr("c_custkey div 60") * 60, F.lit(30)), F.lit(1200)).alias("lo"))


@query("input_mask_point", "SELECT l_orderkey, l_linenumber, ceil(l_quantity * 24.4140625::DOUBLE - 1e-6)::BIGINT AS first_sample, greatest(ceil(l_quantity * 24.4140625::DOUBLE - 1e-6)::BIGINT - 100, 0) AS anchor FROM lineitem")
def input_mask_point(spark, sf):
    first = F.ceil(F.col("l_quantity") * 24.4140625 - 1e-6)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", first.alias("first_sample"), F.greatest(first - 100, F.lit(0)).alias("anchor"))


@query("protocol_lookup", "WITH r(prefix, spec) AS (VALUES ('http', 'any'), ('https://', 'secure'), ('https://m.', 'mobile'), ('http://blog.', 'blog')), m AS (SELECT page_id, spec, row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) AS i FROM pages JOIN r ON starts_with(url, prefix)) SELECT page_id, spec FROM m WHERE i = 1")
def protocol_lookup(spark, sf):
    """The longest prefix decides."""
    rules = {"http": "any", "https://": "secure", "https://m.": "mobile", "http://blog.": "blog"}
    return table(spark, sf, "pages").select("page_id", P.longest_prefix(F.col("url"), rules).alias("spec")).where("spec is not null")


@query("unit_scale", "SELECT o_orderkey, o_totalprice * CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1e6 WHEN '2' THEN 1e3 WHEN '3' THEN 1.0 END AS scaled FROM orders WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3')")
def unit_scale(spark, sf):
    factor = F.create_map(*(F.lit(x) for pair in {"1": 1e6, "2": 1e3, "3": 1.0}.items() for x in pair))
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * F.element_at(factor, F.substring("o_orderpriority", 1, 1))).alias("scaled"))
    return rows.where("scaled is not null")


@query("window_override", "SELECT e.event_type, coalesce(w.lo, -30) AS lo, coalesce(w.hi, 60) AS hi, count(*) AS n FROM events e LEFT JOIN (VALUES ('click', -10, 20), ('error', -60, 120)) w(event_type, lo, hi) ON w.event_type = e.event_type GROUP BY 1, 2, 3")
def window_override(spark, sf):
    """A default window with overrides per key."""
    over = spark.createDataFrame([("click", -10, 20), ("error", -60, 120)], "event_type string, lo int, hi int")
    n = events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))
    return n.join(over, "event_type", "left").select("event_type", F.coalesce("lo", F.lit(-30)).alias("lo"), F.coalesce("hi", F.lit(60)).alias("hi"), "n")


@query("gate_record", "SELECT event_type, '[' || string_agg('{\"user\":' || user_id || ',\"n\":' || n || '}', ',' ORDER BY user_id) || ']' AS record FROM (SELECT event_type, user_id, count(*) AS n FROM events WHERE value > 100 GROUP BY 1, 2) GROUP BY 1")
def gate_record(spark, sf):
    g = events(spark, sf).where("value > 100").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    rows = F.sort_array(F.collect_list(F.struct(F.col("user_id").alias("user"), "n")))
    return g.groupBy("event_type").agg(F.to_json(rows).alias("record"))


@query("event_table", "SELECT o_custkey, string_agg(o_orderpriority || '=' || s, ',' ORDER BY o_orderpriority) AS routes FROM (SELECT o_custkey, o_orderpriority, max(o_orderstatus) AS s FROM orders GROUP BY 1, 2) GROUP BY 1")
def event_table(spark, sf):
    """A map of consumer to route per event."""
    g = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderstatus").alias("s"))
    m = F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderpriority", "s"))))
    return g.groupBy("o_custkey").agg(m.alias("m")).select("o_custkey", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("routes"))


@query("consumer_gate", "WITH h AS (SELECT c_mktsegment AS consumer, c_nationkey AS unit, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS held FROM customer GROUP BY 1, 2) SELECT consumer, unit, CASE WHEN n < 5 THEN 'not computed' WHEN held = n THEN 'held' WHEN held > 0 THEN 'part held' ELSE 'runs' END AS status FROM h")
def consumer_gate(spark, sf):
    h = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("consumer"), F.col("c_nationkey").alias("unit")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("held"))
    return h.select("consumer", "unit", F.when(F.col("n") < 5, "not computed").when(F.col("held") == F.col("n"), "held").when(F.col("held") > 0, "part held").otherwise("runs").alias("status"))


@query("recompute_proof", "WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1), b AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders) SELECT count(*) AS n, count(*) FILTER (abs(a.v - b.v) <= 1e-6) AS exact, count(*) FILTER (a.v > b.v) AS above FROM a JOIN b USING (k)")
def recompute_proof(spark, sf):
    """Recomputed values against the stored ones."""
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    both = a.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("w")), "k")
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("v") - F.col("w")) <= 1e-6).alias("exact"), F.count_if(F.col("v") > F.col("w")).alias("above"))


@query("replay_state", "SELECT user_id, max_by(event_type, (ts, event_id)) AS state, max(epoch_us(ts)) FILTER (event_type = 'signup') AS signup_us, max_by(value, (ts, event_id)) FILTER (event_type = 'signup') AS carried, count(*) AS n FROM events GROUP BY 1")
def replay_state(spark, sf):
    """The latest action per key with the fields that its last origin set; order of arrival does not matter."""
    from driftglass.operators.log import replay

    return replay(events(spark, sf), "user_id", "event_type", "us", "event_id", "signup", "value")


@query("log_compact", "WITH a AS (SELECT user_id, event_type, value FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT user_id, event_type, value FROM events WHERE event_type <> 'click') SELECT count(*) AS before, (SELECT count(*) FROM (SELECT DISTINCT * FROM a)) AS after FROM a")
def log_compact(spark, sf):
    e = events(spark, sf).select("user_id", "event_type", "value", "event_id")
    a = e.where("event_type IN ('click', 'view')").union(e.where("event_type <> 'click'")).drop("event_id")
    each = a.groupBy("user_id", "event_type", "value").agg(F.count("*").alias("c"))
    return each.agg(F.sum("c").alias("before"), F.count("*").alias("after"))


@query("resume_antijoin", "SELECT o_orderpriority, count(*) AS todo FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 30) GROUP BY 1")
def resume_antijoin(spark, sf):
    """Keys without a finished record are still to do."""
    done = table(spark, sf, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf, "orders").join(done, "o_orderkey", "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("todo"))
