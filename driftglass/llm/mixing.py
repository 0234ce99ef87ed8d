"""Mixing sources to target weights by Pfair scheduling.

A source's rows, in the order of a hash, are cut into blocks. With integer weights w of sum P, the j-th block of a
source is released at floor(j P / w) and due at ceil((j + 1) P / w); earliest deadline first among the released blocks
meets every deadline, so at any time each source is within one block of its share. The schedule has period P and is
worked out once for a period; a block's slot then follows from its number alone.

When a source runs out, the others go on by their own weights in a new phase, so no row is dropped or repeated; there
are at most as many phases as sources. Sources and weights are parameters or counts per source: the tables that reach
the driver have a row per source and, in each phase, P.

Edge cases: a null source is a source of its own; null and repeated ids are rows like others; an empty table gives no
rows; a source without a weight has weight 1; other columns stay.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, free_names, numbered

#: Rows of the period tables up to which they are broadcast; beyond, Spark chooses the join.
SMALL = 100_000


def windows(weight: int, period: int) -> list[tuple[int, int]]:
    """(release, deadline) of each of a source's blocks in a period."""
    return [(j * period // weight, -(-(j + 1) * period // weight)) for j in range(weight)]


def schedule(weights: list[int]) -> list[list[int]]:
    """Slots of each source's blocks in one period, by earliest deadline first; ties go to the earlier source."""
    period = sum(weights)
    coming = sorted((r, d, i) for i, w in enumerate(weights) for r, d in windows(w, period))
    ready: list[tuple[int, int]] = []
    slots: list[list[int]] = [[] for _ in weights]
    at = 0
    for t in range(period):
        while at < len(coming) and coming[at][0] <= t:
            heapq.heappush(ready, coming[at][1:])
            at += 1
        deadline, i = heapq.heappop(ready)
        assert t < deadline
        slots[i].append(t)
    return slots


def phases(blocks: list[int], weights: list[int]) -> list[dict]:
    """One entry per phase and active source: phase, source, first block, blocks, slot where the phase starts, weight,
    period, slots."""
    out, left, done, start = [], list(blocks), [0] * len(blocks), 0
    phase = 0
    while active := [i for i, n in enumerate(left) if n]:
        slots = schedule([weights[i] for i in active])
        period = sum(weights[i] for i in active)
        slot = lambda k, b: slots[k][b % len(slots[k])] + period * (b // len(slots[k]))  # noqa: B023, E731
        stop = min(slot(k, left[i]) for k, i in enumerate(active))
        for k, i in enumerate(active):
            n = stop // period * len(slots[k]) + bisect_left(slots[k], stop % period)
            out.append({"phase": phase, "source": i, "first": done[i], "blocks": n, "start": start, "weight": weights[i], "period": period, "slots": slots[k]})
            left[i], done[i] = left[i] - n, done[i] + n
        start, phase = start + stop, phase + 1
    return out


def root_weights(counts: list[int], scale: int = 1000) -> list[int]:
    """Integer weights in proportion to the square root of the rows: large sources are held back, small ones brought up."""
    roots = [isqrt(n << 20) for n in counts]
    return [max(1, scale * r // max(1, sum(roots))) for r in roots]


def interleave(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = 32, id_col: str = "doc_id", source_col: str = "source", tie: list[str] = ()) -> DataFrame:
    """Rows (id, source, tie columns) with block (number in the source), release and deadline (slots of the phase),
    phase, slot (of all blocks), and position (of all rows, gapless from 0). Without weights: ``root_weights``."""
    spark = docs.sparkSession
    stage = Stage(spark, "mixing")
    outer = [id_col, source_col, *tie]  # inside, columns have names of our own
    inner = [f"in{i}" for i in range(len(outer))]
    rows = docs.select(*(F.col(o).alias(i) for o, i in zip(outer, inner, strict=True)))
    id_col, source_col, tie = inner[0], inner[1], inner[2:]
    ranked = stage.save(numbered(rows, stage, source_col, [F.col(id_col), *map(F.col, tie)], "rank"), "ranked")
    counts = sorted(((r[0], r[1]) for r in ranked.groupBy(source_col).count().collect()), key=lambda x: (x[0] is not None, x[0] or ""))
    names, rows_of = [x for x, _ in counts], [n for _, n in counts]
    shares = root_weights(rows_of) if weights is None else [weights.get(x, 1) for x in names]
    plan = phases([-(-n // block_rows) for n in rows_of], shares)
    sources = spark.createDataFrame(list(enumerate(names)), f"_s int, _name {dict(ranked.dtypes)[source_col]}")
    spans = spark.createDataFrame([(p["source"], p["phase"], p["first"], p["first"] + p["blocks"], p["start"], p["weight"], p["period"]) for p in plan], "_s int, phase int, _first long, _stop long, _start long, _weight long, _period long")
    inside = spark.createDataFrame([(p["source"], p["phase"], k, t) for p in plan for k, t in enumerate(p["slots"])], "_s int, phase int, _k long, _t long")
    hint = F.broadcast if sum(p["weight"] for p in plan) <= SMALL else lambda df: df
    # a source's last block may be short: rows that later positions come forward
    short = []
    for p in plan:
        i, last = p["source"], -(-rows_of[p["source"]] // block_rows) - 1
        if p["first"] <= last < p["first"] + p["blocks"] and rows_of[i] % block_rows:
            b = last - p["first"]
            short.append((p["start"] + p["slots"][b % p["weight"]] + p["period"] * (b // p["weight"]), block_rows - rows_of[i] % block_rows))
    missing = F.array(*(F.struct(F.lit(a).cast("long").alias("slot"), F.lit(n).cast("long").alias("n")) for a, n in short)) if short else None
    block = F.expr(f"rank div {block_rows}")
    out = ranked.withColumn("block", block).join(hint(sources), F.col(source_col).eqNullSafe(F.col("_name")))
    out = out.join(hint(spans), (out["_s"] == spans["_s"]) & (F.col("block") >= F.col("_first")) & (F.col("block") < F.col("_stop"))).drop(spans["_s"])
    number = F.col("block") - F.col("_first")
    out = out.withColumn("_k", F.pmod(number, F.col("_weight"))).join(hint(inside), ["_s", "phase", "_k"])
    out = out.withColumn("slot", F.col("_start") + F.col("_t") + F.col("_period") * F.floor(number / F.col("_weight")))
    before = F.lit(0) if missing is None else F.aggregate(F.filter(missing, lambda x: x["slot"] < F.col("slot")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    position = F.col("slot") * block_rows + F.pmod("rank", F.lit(block_rows)) - before
    release, deadline = F.expr("(block - _first) * _period div _weight"), F.expr("((block - _first + 1) * _period + _weight - 1) div _weight")
    return out.select(*(F.col(i).alias(o) for o, i in zip(outer, inner, strict=True)), "block", "phase", release.alias("release"), deadline.alias("deadline"), "slot", position.cast("long").alias("position"))


def in_order(docs: DataFrame, weights: dict[str | None, int] | None = None, block_rows: int = 32, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, range-partitioned and sorted by their position in the mix. Rows of equal id,
    source and text share the first one's position."""
    text, position = free_names(docs, "text", "position")
    keyed = docs.withColumn(text, F.xxhash64(text_col))
    mixed = interleave(keyed, weights, block_rows, id_col, source_col, [text])
    keys = [id_col, source_col, text]
    rights = free_names(keyed, *(f"right{i}" for i in range(3)))
    first = mixed.groupBy(*keys).agg(F.min("position").alias(position))
    right = first.select(*(F.col(c).alias(r) for r, c in zip(rights, keys, strict=True)), position)
    match = F.lit(True)
    for c, r in zip(keys, rights, strict=True):
        match = match & F.col(c).eqNullSafe(F.col(r))
    placed = keyed.join(right, match)
    return placed.repartitionByRange(position).sortWithinPartitions(position).select(docs.columns)
