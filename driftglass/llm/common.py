"""Shared pieces of the training-data operators: staged tables, components, distributed numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests on one machine) a folder of our own is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="driftglass-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


#: Set while a table is written: it is read from there on, not the shuffles behind it, whose files go when it stands and
#: not when the driver collects its garbage; and Python workers get small batches.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


class Stage:
    """Tables written to the shared folder, so that a lost executor costs a re-read and not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/driftglass-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path, conf = f"{self.root}/{label}", self.spark.conf
        before = {k: conf.get(k) for k in _WRITING}
        for k, v in _WRITING.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str) -> None:
        """Delete a table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have, in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}".lower() in taken:
            name = f"_{name}"
        found.append(f"_{name}")
        taken.add(f"_{name}".lower())
    return found


def text_key(docs: DataFrame, text_col: str, stage: Stage) -> Column:
    """A long for each text of ``docs``, the same for equal texts (null is empty) and another for all others.

    It is the text's 64-bit hash, except for the few texts that share it with another text: those are told apart by a
    second hash. Their number is about n^2 / 2^65 for n texts, none below some billions; their hashes reach the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    first, second = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    pairs = docs.select(first.alias("k"), second.alias("k2")).distinct()
    clashes = [r.k for r in pairs.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k").collect()]
    return F.when(first.isin(clashes), F.xxhash64(first, second)).otherwise(first) if clashes else first


def connected_components(edges: DataFrame, stage: Stage) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: root is the smallest node reachable.

    Alternating large-star and small-star steps: each round relinks every neighbour to the smallest node known, so the
    rounds grow with the logarithm of a chain's length. Every round is a written table; no label leaves the executors.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stage.save(pairs, "links-0")
    before, round_ = None, 0
    while True:
        round_ += 1
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = stage.save(small, f"links-{round_}")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
        if round_ > 1:
            stage.drop(f"links-{round_ - 2}")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def numbered(df: DataFrame, stage: Stage, group: str, order: list[Column], name: str, cell_rows: int = 20_000) -> DataFrame:
    """Adds ``name``: gapless from 0 inside each ``group``, without bringing a group into one task.

    A group is cut into cells by a hash of the ordering columns; ``cell_rows`` sets the mean size of a cell, so a group
    with a third of all rows becomes many cells. A cell's offset is the running count of the cells before it. Rows
    whose ordering columns are all equal share a cell and are told apart arbitrarily. The number of groups may be
    anything; the window over cells of one group holds rows of that group divided by ``cell_rows``.
    """
    hashed = df.withColumn("_h", F.xxhash64(*order))
    sizes = hashed.groupBy(group).agg(F.count("*").alias("_n")).select(F.col(group).alias("_g"), F.ceil(F.col("_n") / cell_rows).cast("long").alias("_cells"))
    placed = hashed.join(sizes, F.col(group).eqNullSafe(F.col("_g"))).drop("_g").withColumn("_cell", F.pmod("_h", "_cells"))
    placed = stage.save(placed.drop("_cells"), f"cells-{name}")
    counts = placed.groupBy(group, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(group, "_cell").orderBy("_h", *order))
    ranked = placed.withColumn("_rank", rank)
    return ranked.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_cell") == F.col("_c"))).withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_g", "_c", "_before", "_rank", "_cell", "_h")


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
