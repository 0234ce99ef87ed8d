"""Versioned tables and integrity: content hashes, differences, manifests, duplicates and guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of the row as JSON with sorted fields; nulls are absent."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256)


def multiset_digest(content: Column) -> Column:
    """Aggregate: digest of a group's SHA-256 values, whatever their order. The values are added up as four words of 60
    bits, so partial sums combine and no group is gathered; nulls are left out."""
    words = (F.sum(F.conv(F.substr(content, F.lit(1 + 15 * i), F.lit(15)), 16, 10).cast("decimal(20,0)")) for i in range(4))
    return F.sha2(F.concat_ws(",", *(w.cast("string") for w in words)).cast("binary"), 256)


def diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or changed."""
    a = old.select(F.col(key), row_hash(columns).alias("_a"))
    b = new.select(F.col(key), row_hash(columns).alias("_b"))
    both = a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(key, F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed").alias("change"))


def append_new(table: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """The table with the entries; a key that is there already is an error."""
    marked = entries.join(table.select(key, F.lit(True).alias("_there")), key, "left")
    checked = marked.withColumn(key, F.when(F.col("_there"), F.raise_error(F.lit("a key is there already"))).otherwise(F.col(key)))
    return table.unionByName(checked.drop("_there"))


def check_manifest(manifest: DataFrame, listing: DataFrame, key: str, size: str) -> DataFrame:
    a = manifest.select(F.col(key).alias("_k"), F.col(size).alias("_a"))
    b = listing.select(F.col(key).alias("_l"), F.col(size).alias("_b"))
    both = a.join(b, F.col("_k") == F.col("_l"), "full")
    reason = F.when(F.col("_l").isNull(), "missing").when(F.col("_k").isNull(), "unlisted").when(F.col("_a") != F.col("_b"), "size")
    return both.select(F.coalesce("_k", "_l").alias(key), reason.alias("reason")).where("reason is not null")


def duplicates(rows: DataFrame, key: str, size: str, content: str) -> DataFrame:
    """(k, n, first): contents held by several rows. Sizes are counted first, and only contents whose size repeats are
    hashed; the content itself is never shuffled."""
    sizes = rows.groupBy(size).agg(F.count("*").alias("_n")).where("_n > 1").select(size)
    hashed = rows.select(key, size, F.sha2(F.col(content).cast("binary"), 256).alias("k"))
    return hashed.join(sizes, size, "left_semi").groupBy("k").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def union_log(shards: list[DataFrame], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, shards).dropDuplicates(columns)


def guards(found: dict[str, DataFrame]) -> DataFrame:
    """One row per guard with the number of rows that violate it."""
    counts = (df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("guard"), "violations") for name, df in found.items())
    return reduce(DataFrame.union, counts)
