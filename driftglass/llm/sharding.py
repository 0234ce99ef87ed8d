"""Byte-balanced shards by minimax contiguous partition.

Rows with equal texts stay together. Texts are ordered by hash; each of ``2**GROUP_BITS`` hash ranges is an atomic group,
so the group sizes are a table of fixed length whatever the input, and equal texts share a group. The smallest feasible
capacity is found by binary search, each try checked greedily (a group above its fair share is the least there can be),
and the order is cut there: a shard closes at the capacity, or as soon as it holds its share of what is left and the
rest still fits. All shards are contiguous in the order, and none is above the smallest capacity.

Only the group sizes (at most ``2**GROUP_BITS`` numbers) come to the driver, and only the cuts go back.

Edge cases: a null text has size 16 and shares a group with empty texts; null and repeated ids are rows like others;
an empty table gives no rows; with fewer groups than shards some shards stay empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, numbered

GROUP_BITS = 14
ROW_BYTES = 16


def shards_needed(sizes: list[int], capacity: int) -> int:
    """Greedy count of contiguous shards; more than there are groups where one does not fit."""
    used, load = 1, 0
    for size in sizes:
        if size > capacity:
            return len(sizes) + 1
        if load + size > capacity:
            used, load = used + 1, 0
        load += size
    return used


def smallest_capacity(sizes: list[int], shards: int) -> int:
    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), max(sum(sizes), 0)
    while low < high:
        middle = (low + high) // 2
        if shards_needed(sizes, middle) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def cut(sizes: list[int], shards: int) -> list[int]:
    """First group of each shard but the first; no shard is above the smallest capacity."""
    capacity = smallest_capacity(sizes, shards)
    need, load = [0] * (len(sizes) + 1), 0  # shards that the groups from i on need
    for i in range(len(sizes) - 1, -1, -1):
        load += sizes[i]
        need[i] = need[i + 1]
        if load > capacity or i == len(sizes) - 1:
            need[i], load = need[i + 1] + 1, sizes[i]
    cuts, load, left = [], 0, sum(sizes)
    share = left / shards
    for i, size in enumerate(sizes):
        rest = shards - len(cuts) - 1
        full = load + size > capacity or load + size / 2 > share
        if load and full and rest and need[i] <= rest:
            cuts.append(i)
            left, load = left - load, 0
            share = left / rest
        load += size
    return cuts


def by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, shard, and slot, gapless from 0 in the shard."""
    stage, text = Stage(docs.sparkSession, "shards"), F.coalesce(F.col(text_col), F.lit(""))
    group = F.expr(f"shiftrightunsigned(h, {64 - GROUP_BITS})").cast("int")
    sized = docs.select(F.col(id_col), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = stage.save(sized.withColumn("group", group).drop("h"), "sizes")
    groups = sorted((r["group"], r["size"]) for r in rows.groupBy("group").agg(F.sum("size").alias("size")).collect())
    cuts = [groups[i][0] for i in cut([size for _, size in groups], shards)]
    shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("group"))) if cuts else F.lit(0)
    placed = rows.withColumn("shard", shard.cast("int")).drop("group")
    return numbered(placed, stage, "shard", [F.col(id_col), F.col("size"), F.col("text_crc32")], "slot")
