"""Quality rules: counts of a text's own shape, and a hashed n-gram log-likelihood ratio.

The words and word pairs of a text are hashed into ``BUCKETS`` buckets. Two multinomials over the buckets are counted:
the raw corpus, from every document, and the trusted target, from documents labelled good. A text's score is the mean
over its n-grams of log target(b) - log raw(b); below ``THRESHOLD`` it is rejected, always and for every document.

The target is counted from at most ``TRUSTED`` labelled documents (those whose ids hash lowest), so their ids can be
broadcast; the raw counts cover everything. Counts are summed in the tasks before they are shuffled, and the model is
``BUCKETS`` numbers in one row, read by each task as a scalar. Scoring adds columns to rows: nothing is shuffled.

Edge cases: a null or blank text has no words, fails the base rule and has score 0; rows with null or repeated ids are
judged like others (only labels are matched by id); extra columns stay, one named like the result is replaced; with no
labels or no documents the model is flat and every score is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, free_names

BUCKETS = 1 << 16
TRUSTED = 20_000
THRESHOLD = -0.15
#: Counts that each bucket has before any document: rare n-grams say little.
PRIOR = 10
BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEATED_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def let(value: Column, body) -> Column:
    """An array with the one value ``body(value)``; ``value`` is computed once however often the body names it."""
    return F.transform(F.array(value), body)


def _pairs(words: Column) -> Column:
    """(word, next word or null) for each word."""
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def _bucket(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def _covered_by_repeats(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; windows are compared by hash and sorted."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    triples = F.transform(F.arrays_zip(*(F.slice(words, k + 1, n).alias(c) for k, c in enumerate("abc"))), lambda t: F.xxhash64(t["a"], t["b"], t["c"]))

    def places(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def union(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def count(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(ordered, lambda o: let(places(o), union)[0])[0]
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    return let(triples, count)[0]


def _base(text: Column, words: Column) -> list[Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeated_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    return [
        F.size(words).cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeated_lines.cast("long").alias("n_dup_lines"),
        _covered_by_repeats(words).cast("long").alias("n_repeat_words"),
    ]


def gram_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, raw, target): counts over all documents, and over those whose id is in ``trusted``."""
    ids = trusted.select(F.col("doc_id").alias("_trusted")).distinct()
    flagged = docs.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("w")).join(F.broadcast(ids), F.col("_id") == F.col("_trusted"), "left")
    each = flagged.select(F.col("_trusted").isNotNull().alias("good"), F.explode(_pairs(F.col("w"))).alias("t"))
    word, after = F.col("t")["a"], F.col("t")["b"]
    grams = each.select("good", F.explode(F.array(_bucket(word), F.when(after.isNotNull(), _bucket(word, after)))).alias("bucket")).where("bucket is not null")
    return grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("good").alias("target"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """At most ``TRUSTED`` ids labelled good and not toxic, those whose hashes are lowest."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED)


def fit(docs: DataFrame, labels: DataFrame, stage: Stage, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row with ``llr``: log target - log raw of each bucket. The raw multinomial has ``PRIOR`` counts more a bucket,
    the target as many in its own scale: (target R / T + PRIOR) / (raw + PRIOR) for totals R and T, so that few labels
    or few documents move no score by themselves."""
    counts = gram_counts(docs, trusted_ids(labels), id_col, text_col)
    dense = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["raw", "target"])
    row = dense.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"), F.sum("raw").alias("r"), F.sum("target").alias("t"))
    ratio = lambda x: F.when(F.col("t") == 0, 0.0).otherwise(F.log(x["target"] * F.col("r") / F.col("t") + PRIOR) - F.log(x["raw"] + F.lit(PRIOR)))
    return stage.save(row.select(F.transform("c", ratio).alias("llr")), "model")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "quality") -> DataFrame:
    """The rows with a struct column ``out``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    score and kept."""
    model = fit(docs, labels, Stage(docs.sparkSession, "quality"), id_col, text_col)
    held = free_names(docs, "llr")[0]
    scored = docs.withColumn(held, model.select("llr").scalar())
    text = F.coalesce(F.col(text_col), F.lit(""))

    def score(words: Column) -> Column:
        llr = F.col(held)
        one = lambda t: F.get(llr, _bucket(t["a"])) + F.when(t["b"].isNotNull(), F.get(llr, _bucket(t["a"], t["b"]))).otherwise(0.0)
        total = F.aggregate(_pairs(words), F.lit(0.0), lambda acc, t: acc + one(t))
        return F.when(F.size(words) == 0, 0.0).otherwise(total / (2 * F.size(words) - 1))

    counted = let(words_of(text), lambda w: F.struct(*_base(text, w), score(w).alias("score")))
    full = scored.withColumn(out, F.explode(counted)).drop(held)
    q = F.col(out)
    failed = (q["n_words"] < MIN_WORDS) | (100 * q["n_repeat_words"] > REPEATED_PERCENT * q["n_words"])
    return full.withColumn(out, q.withField("base_failed", failed).withField("kept", ~failed & (q["score"] >= THRESHOLD)))
