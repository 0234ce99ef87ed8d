"""Documents of a recording store as tables: settings that keep unknown keys, mask files, hashed tables, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import merge_document, write_checked
from .shared import exists
from .versions import table_hash

#: Rows of a report's table at most: it is rendered on the driver.
MOST_ROWS = 1_000


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) rows of a document's last version; empty if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, value string")
    rows = spark.read.schema("key string, value string, version int").parquet(path)
    last = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == last).select("key", "value")


def update_document(spark: SparkSession, path: str, changes: DataFrame) -> int:
    """Adds a version with new values of some keys; keys that are not named stay as they were, known or not. Gives its
    number. Versions are never written over."""
    repeated = changes.groupBy("key").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"key {repeated[0].key} is given twice")
    old = read_document(spark, path)
    last = spark.read.parquet(path).agg(F.max("version")).first()[0] if exists(spark, path) else 0
    merge_document(old, changes.select("key", "value"), "key").write.mode("errorifexists").parquet(f"{path}/version={last + 1}")
    return last + 1


def labels_of(text: Column) -> Column:
    """Channel labels from a header's text, ``a;b;c``: trimmed, in order. No text, or one without a label, is null and not a
    guess; an empty label inside stays empty."""
    parts = F.transform(F.split(text, ";"), lambda s: F.trim(s))
    return F.when(F.exists(parts, lambda s: s != ""), parts)


def folder_time(path: Column) -> Column:
    """The time that a folder's name ends with, ``name-yyMMdd-HHmmss``; null without one."""
    found = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"-(\d{6}-\d{6})$", 1)
    return F.try_to_timestamp(F.concat(F.lit("20"), F.nullif(found, F.lit(""))), F.lit("yyyyMMdd-HHmmss"))


def clock_disagrees(clock: Column, path: Column, seconds: int = 60) -> Column:
    """Whether an instrument's clock and its folder's name are farther apart than some seconds; null where either is missing."""
    return F.abs(F.unix_micros(clock) - F.unix_micros(folder_time(path))) > seconds * 1_000_000


def write_masks(path: str, spans: DataFrame, gate: DataFrame, provenance: DataFrame, keys: list[str]) -> None:
    """Writes an epoch's invalid spans (keys, start, stop), gates (keys, kept, least) and provenance (keys, settings as JSON).
    Refuses spans that are empty or reach before 0, gates outside [0, 1], units with spans but without a gate, and gates without exactly
    one provenance; nothing is written then."""
    missing = spans.select(*keys).distinct().join(gate, keys, "left_anti")
    without = gate.join(provenance.where("settings is not null").groupBy(*keys).count().where("count = 1"), keys, "left_anti")
    twice = gate.groupBy(*keys).count().where("count > 1")
    for rows, what in ((missing, "spans without a gate"), (without, "a gate without one provenance"), (twice, "two gates of a unit")):
        bad = rows.limit(1).collect()
        if bad:
            raise ValueError(f"{what}: {[bad[0][k] for k in keys]}")
    bad = spans.where(~F.coalesce(F.expr("start >= 0 and stop > start"), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"a span is empty or reaches before 0: {bad[0]}")
    write_checked(gate, f"{path}/gate", {"a share lies between 0 and 1": "kept between 0 and 1 and least between 0 and 1"})
    write_checked(spans, f"{path}/spans", {"spans have a length": "stop > start"})
    write_checked(provenance, f"{path}/provenance", {"settings are JSON": "try_parse_json(settings) is not null"})


def read_masks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/spans"), spark.read.parquet(f"{path}/gate"), spark.read.parquet(f"{path}/provenance")


def write_hashed(rows: DataFrame, root: str) -> str:
    """Writes a table under the hash of its contents and gives it; the same contents are written once."""
    name = table_hash(rows)
    if not exists(rows.sparkSession, f"{root}/hash={name}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(f"{root}/hash={name}")
    return name


def read_hashed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table of this hash; one whose contents were changed is refused."""
    rows = spark.read.parquet(f"{root}/hash={name}")
    if table_hash(rows) != name:
        raise ValueError(f"the table {name} was changed")
    return rows


def markdown_table(rows: DataFrame, order: list[str], digits: int = 4) -> str:
    """A small table as Markdown, in an order; numbers are rounded, null is a dash, bars are escaped. A table of over
    ``MOST_ROWS`` rows is refused."""
    found = rows.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"over {MOST_ROWS} rows in a report")

    def cell(v: object) -> str:
        text = "-" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
        return text.replace("|", "\\|").replace("\n", " ")

    lines = [rows.columns, ["---"] * len(rows.columns), *([cell(v) for v in r] for r in found)]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines) + "\n"


def write_report(path: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> None:
    """Writes each table as Parquet, and all of them in one Markdown text with their names as headings."""
    text = "\n".join(f"## {name}\n\n{markdown_table(rows, order)}" for name, (rows, order) in tables.items())
    for name, (rows, _) in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark = next(iter(tables.values()))[0].sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/report")


def write_aliases(path: str, aliases: DataFrame) -> None:
    """Writes (alias, name, n); an alias with two names, or one that is another's name, is refused."""
    clash = aliases.groupBy("alias").agg(F.count_distinct("name").alias("n")).where("n > 1").select("alias")
    chain = aliases.where("alias <> name").select("alias").join(aliases.where("alias <> name").select(F.col("name").alias("alias")), "alias", "left_semi")
    bad = clash.union(chain).limit(1).collect()
    if bad:
        raise ValueError(f"alias {bad[0].alias} has no one name")
    aliases.write.mode("errorifexists").parquet(path)
