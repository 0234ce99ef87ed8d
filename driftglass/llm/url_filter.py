"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule ``host/path`` fits its host and all subdomains where the URL's path starts with the rule's; the longest fitting
rule decides (of equally long ones a block, then the first in order). URLs that rules decide are also the labelled
examples the trees learn from, unless the caller has labels of their own: the trees carry the rules' judgement to URLs
of similar build that no rule names.

Features, all from the URL's text by built-in functions: lengths of URL, host, path and query, host labels, path depth,
digits and their share, hyphens, Shannon entropy of the characters, query parameters, numeric segments, scheme, and
the smoothed share of blocked examples under the URL's last and last two host labels (for an example: of those in the
other folds, so that its own label is not among its features). The trees are Spark ML's, fitted
on at most ``EXAMPLES`` labelled URLs (the distinct ones whose hashes are lowest); suffix statistics come from the same
examples, so their table is no longer than the examples and is broadcast.

Edge cases: a null URL, or one without ``://``, has empty host and path, fits no rule, and is judged by the trees on
its text; repeated rows are judged alike; rows with null ids stay; with labels of one kind only every verdict beyond
the rules is that kind, with none it is allow; an empty table gives no rows; other columns stay, one named like a
result is replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage

EXAMPLES = 20_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
Rule = tuple[str, str]


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased, other characters as they are."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. rules: (``host/path``, allow or block)."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block", [-ord(c) for c in r[0]])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    n = F.length(text)

    def of(chars: Column) -> Column:
        share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
        return F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))

    return F.when(n > 0, of(F.array_remove(F.array_distinct(F.split(text, "")), ""))).otherwise(0.0)


def features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    count = lambda of, mark: F.length(of) - F.length(F.replace(of, F.lit(mark), F.lit("")))
    return {
        "f_length": F.length(text),
        "f_host_length": F.length(host),
        "f_path_length": F.length(path),
        "f_query_length": F.length(query),
        "f_labels": F.when(host == "", 0).otherwise(count(host, ".") + 1),
        "f_depth": count(path, "/"),
        "f_digits": digits,
        "f_digit_share": F.when(text == "", 0.0).otherwise(digits / F.length(text)),
        "f_hyphens": count(text, "-"),
        "f_entropy": _entropy(text),
        "f_parameters": F.when(query == "", 0).otherwise(count(query, "&") + 1),
        "f_numbers": F.size(F.regexp_extract_all(path, F.lit(r"/([0-9]+)(?=/|$|\.)"), 1)),
        "f_secure": F.when(text.startswith("https"), 1).otherwise(0),
    }


def _suffix_counts(sample: DataFrame) -> DataFrame:
    """(k, suffix, fold, n, blocked): labelled URLs by their last k host labels and fold."""
    suffix = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.substring_index("host", ".", -k).alias("suffix")) for k in (1, 2))))
    return sample.select("label", "fold", suffix.alias("s")).groupBy("s.k", "s.suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))


def _suffixes(df: DataFrame, counts: DataFrame, prior: float, held_out: bool) -> DataFrame:
    """Adds f_one and f_two, the share of blocked examples under the last label and the last two; ``held_out``: without
    the examples of the row's own fold, so that no label tells itself."""
    for k, name in ((1, "f_one"), (2, "f_two")):
        of = counts.where(F.col("k") == k)
        total = of.groupBy(F.col("suffix").alias("_s")).agg(F.sum("n").alias("_n"), F.sum("blocked").alias("_b"))
        df = df.join(F.broadcast(total), F.substring_index("host", ".", -k) == F.col("_s"), "left").drop("_s")
        n, b = F.coalesce("_n", F.lit(0)), F.coalesce("_b", F.lit(0.0))
        if held_out:
            own = of.select(F.col("suffix").alias("_s"), F.col("fold").alias("_f"), F.col("n").alias("_on"), F.col("blocked").alias("_ob"))
            df = df.join(F.broadcast(own), (F.substring_index("host", ".", -k) == F.col("_s")) & (F.col("fold") == F.col("_f")), "left")
            n, b = n - F.coalesce("_on", F.lit(0)), b - F.coalesce("_ob", F.lit(0.0))
        df = df.withColumn(name, (b + 10 * prior) / (n + 10)).drop("_s", "_f", "_n", "_b", "_on", "_ob")
    return df


def examples_of(labelled: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """At most ``most`` distinct labelled URLs (url, host, path, label), those whose hashes are lowest, in five folds."""
    picked = labelled.distinct().orderBy(F.xxhash64("url"), "url").limit(most)
    return picked.withColumn("fold", F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(5)))


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", trees: int = 8, depth: int = 4, labels: DataFrame | None = None) -> DataFrame:
    """The rows with host, path, rule and verdict (allow or block), and ``block_score`` where the trees decided.
    labels: ``(url, label)``, label 1 to block, to train on instead of the URLs that the rules decide."""
    stage = Stage(pages.sparkSession, "urls")
    row = pages.select(F.struct("*").alias("row"), F.col(url_col).alias("url"))  # the caller's columns keep to themselves
    ruled = row.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = ruled.withColumn("decided", decide(F.col("host"), F.col("path"), rules))
    if labels is None:
        labelled = ruled.where("decided is not null").select("url", "host", "path", F.when(F.col("decided.verdict") == "block", 1.0).otherwise(0.0).alias("label"))
    else:
        labelled = labels.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label")).where("label is not null")
    sample = stage.save(examples_of(labelled), "examples")
    kinds = [r[0] for r in sample.select("label").distinct().collect()]
    verdict = F.coalesce("decided.verdict", F.lit("block" if kinds == [1.0] else "allow"))
    score = F.lit(None).cast("double")
    if len(kinds) == 2:
        prior = sample.agg(F.avg("label")).first()[0]
        counts = stage.save(_suffix_counts(sample), "suffixes")
        assemble = lambda df, held_out: _suffixes(df.withColumns({k: v.cast("double") for k, v in features(F.col("url"), F.col("host"), F.col("path")).items()}), counts, prior, held_out)
        examples = assemble(sample, True)
        names = [c for c in examples.columns if c.startswith("f_")]
        assembler = VectorAssembler(inputCols=names, outputCol="features")
        boosted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, seed=7, cacheNodeIds=False)
        boosted.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("p")
        model = boosted.fit(assembler.transform(examples).select("features", "label"))
        model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("p")
        ruled = model.transform(assembler.transform(assemble(ruled, False)))
        p = vector_to_array("p")[1]
        score = F.when(F.col("decided").isNull(), p)
        verdict = F.coalesce("decided.verdict", F.when(p >= 0.5, "block").otherwise("allow"))
    results = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("decided.rule"), "verdict": verdict, "block_score": score}
    kept = [F.col("row")[c].alias(c) for c in pages.columns if c not in results]
    return ruled.select(*kept, *(c.alias(n) for n, c in results.items()))
