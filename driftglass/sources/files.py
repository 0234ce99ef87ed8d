"""File sources and sinks: listings, fixed-width binary headers, JSON lines, and checked Parquet tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of all files below a root; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def content_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256), hashing only files whose length another file shares; others have a null hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    shared = files.groupBy("length").agg(F.count("*").alias("n")).where("n > 1").select("length")
    hashed = files.join(shared, "length", "left_semi").select("path", F.sha2("content", 256).alias("sha256"))
    return files.select("path", "length").join(hashed, "path", "left")


def fixed_records(spark: SparkSession, root: str, layout: list[tuple[str, str]], size: int, pattern: str = "*") -> DataFrame:
    """Records of ``size`` bytes from binary files. ``layout``: (name, NumPy type) in order, little-endian; what is left
    of a record is skipped, a last partial record dropped."""
    dtype = np.dtype({"names": [n for n, _ in layout], "formats": [f"<{t}" for _, t in layout], "itemsize": size})
    kinds = {"i": "long", "u": "long", "f": "double"}
    schema = "path string, record long, " + ", ".join(f"{n} {kinds[np.dtype(t).kind]}" for n, t in layout)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                rows = np.frombuffer(raw, dtype, count=len(raw) // size)
                columns = [pa.array([path] * len(rows), pa.string()), pa.array(np.arange(len(rows)))]
                columns += [pa.array(rows[n].astype(np.float64 if np.dtype(t).kind == "f" else np.int64)) for n, t in layout]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "record", *(n for n, _ in layout)])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content").mapInArrow(decode, schema)


def read_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines with a declared schema. Absent fields are null; a malformed line is refused, or kept aside in
    ``_corrupt`` if not strict."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if not strict:
        schema = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
        return reader.option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(path)
    return reader.schema(schema).json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """Adds JSON lines in new files; what is there is never rewritten, and null fields are left out."""
    rows.write.mode("append").option("ignoreNullFields", "true").json(path)


def write_checked(rows: DataFrame, path: str, expectations: dict[str, str], partition_by: list[str] = ()) -> None:
    """Writes Parquet if every expectation (a SQL condition) holds in each row; else names the first that fails."""
    checked = rows
    for name, condition in expectations.items():
        column = checked.columns[0]
        failed = ~F.coalesce(F.expr(condition), F.lit(False))
        checked = checked.withColumn(column, F.when(failed, F.raise_error(F.lit(f"expectation failed: {name}"))).otherwise(F.col(column)))
    checked.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def merge_document(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Key-value rows of a document with new values; keys the new ones do not name stay as they were."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
