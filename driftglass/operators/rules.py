"""Rule tables: classification by priority, closed vocabularies, reasons and prefixes. Rules are parameters, bounded in
number, and become expressions; no join is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def strip_suffix(name: Column, suffixes: list[str]) -> Column:
    """Takes off the longest matching suffix, once."""
    out = name
    for s in sorted(suffixes, key=len):
        out = F.when(name.endswith(s), F.substring(name, F.lit(1), F.length(name) - len(s))).otherwise(out)
    return out


def classify(rows: DataFrame, name: str, rules: list[tuple[str, int, str, str]], suffixes: list[str] = ()) -> DataFrame:
    """Adds outcome and rule_id from rules (id, priority, pattern, outcome): the lowest priority that matches decides;
    several outcomes there are ``ambiguous``; the smallest id of those that decide is named; null without a match."""
    stem = strip_suffix(F.col(name), list(suffixes))
    hits = F.array(*(F.when(stem.rlike(pattern), F.struct(F.lit(p).alias("p"), F.lit(i).alias("id"), F.lit(o).alias("o"))) for i, p, pattern, o in rules))
    found = rows.withColumn("_hits", F.filter(hits, lambda x: x.isNotNull()))
    best = F.array_min("_hits")["p"]
    found = found.withColumn("_best", F.filter("_hits", lambda x: x["p"] == best))
    outcomes = F.array_distinct(F.transform("_best", lambda x: x["o"]))
    return found.withColumns({"outcome": F.when(F.size(outcomes) > 1, "ambiguous").when(F.size(outcomes) == 1, outcomes[0]), "rule_id": F.array_min(F.transform("_best", lambda x: x["id"]))}).drop("_hits", "_best")


RULE = "rule_id string, priority int, pattern string, outcome string"
#: Stored rules above this number are refused: they become one expression.
MOST_RULES = 2_000


def check_rules(rules: list[tuple[str, int, str, str]], outcomes: list[str]) -> list[tuple[str, int, str, str]]:
    """The rules in order of priority and id; refuses repeated ids, missing fields, patterns that cannot be read,
    and outcomes outside the vocabulary."""
    import re

    ids = [r[0] for r in rules]
    if len(set(ids)) < len(ids):
        raise ValueError(f"rules with the same id: {sorted({i for i in ids if ids.count(i) > 1}, key=str)}")
    for rule in rules:
        if any(v is None for v in rule):
            raise ValueError(f"rule {rule[0]} lacks a field")
        if rule[3] not in outcomes:
            raise ValueError(f"rule {rule[0]} has an outcome outside the vocabulary: {rule[3]}")
        try:
            re.compile(rule[2])
        except re.error as e:
            raise ValueError(f"rule {rule[0]} has a pattern that cannot be read: {e}") from e
    return sorted(rules, key=lambda r: (r[1], r[0]))


def write_rules(spark: SparkSession, path: str, rules: list[tuple[str, int, str, str]], outcomes: list[str]) -> None:
    """Stores checked rules as JSON lines; what is there is not written over."""
    spark.createDataFrame(check_rules(rules, outcomes), RULE).coalesce(1).write.mode("errorifexists").json(path)


def read_rules(spark: SparkSession, path: str, outcomes: list[str]) -> list[tuple[str, int, str, str]]:
    """Stored rules, checked again. A malformed line is refused."""
    found = spark.read.schema(RULE).option("mode", "FAILFAST").json(path).limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    return check_rules([tuple(r) for r in found], outcomes)


def classify_by(rows: DataFrame, extract: Callable[[DataFrame], Column], rules: list[tuple[str, int, str, str]], suffixes: list[str] = ()) -> DataFrame:
    """``classify`` of what an extractor makes of each row."""
    return classify(rows.withColumn("_name", extract(rows)), "_name", rules, suffixes).drop("_name")


def outside(rows: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    return rows.where(~F.col(column).isin(vocabulary)).groupBy(column).agg(F.count("*").alias("n"))


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in order; unknown checks do not hold."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())


def longest_prefix(path: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for prefix in sorted(table, key=len):
        out = F.when(path.startswith(prefix), table[prefix]).otherwise(out)
    return out
