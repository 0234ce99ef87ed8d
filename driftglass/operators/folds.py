"""Folds in order of time whose state is the last kept row: refractory times, suppression, and cutting into bursts.

No task sees a whole key. A key is cut into blocks of time. Only rows less than ``least`` before a block can be the
last kept one when it starts, so each block is folded once for each of them and once for none; the folds soon agree, so
an outcome is a short beginning of its own and the rest of the common one. A second pass reads one row a block, carries
the kept row over the edges, and names each block's outcome; a join picks it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bursts(rows: DataFrame, keys: list[str], at: str, apart: Callable[[Column], Column], block: float) -> DataFrame:
    """Adds ``_burst``, the time of the first row of each burst: a row starts one where its distance from the row before
    is ``apart``. Windows hold the rows of a block, or a row for each block of a key."""
    inner = Window.partitionBy(*keys, "_b").orderBy(at)
    marked = rows.withColumn("_b", F.floor(F.col(at) / block)).withColumn("_own", F.when(apart(F.col(at) - F.lag(at).over(inner)), F.col(at)))
    blocks = Window.partitionBy(*keys).orderBy("_b")
    ends = marked.groupBy(*keys, "_b").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.max("_own").alias("_inside"))
    enters = F.coalesce(apart(F.col("_first") - F.lag("_last").over(blocks)), F.lit(True))
    ends = ends.withColumn("_enter", F.when(enters, F.col("_first")))
    before = F.last(F.coalesce("_inside", "_enter"), ignorenulls=True).over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_b").alias("_block"), F.coalesce("_enter", before).alias("_carried"))
    same = F.col("_b") == F.col("_block")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    since = F.last("_own", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_since", since).join(ends, same).withColumn("_burst", F.coalesce("_since", "_carried")).select(*rows.columns, "_burst")


def fold_block(at: np.ndarray, strength: np.ndarray, own: int, least: float) -> tuple[list[int], list[dict]]:
    """Folds the rows from ``own`` on, for no kept row before them and for each of the rows before ``own``.

    Gives the rows kept for good by the common fold, and an outcome for each start: ``start`` (-1: none), ``prefix`` and
    ``drop`` (the rows kept for good are ``prefix`` and the common ones without the first ``drop``), the row that is
    the last kept at the end, and whether the start was replaced.
    """
    at_, strength_ = at.tolist(), strength.tolist()
    common: list[int] = []
    states: list[int] = []
    counts: list[int] = []

    def run(start: int) -> dict:
        kept, final, replaced = start, [], False
        for i in range(own, len(at_)):
            if kept < 0 or at_[i] - at_[kept] >= least:
                if kept >= own:
                    final.append(kept)
                kept = i
            elif strength_[i] > strength_[kept]:
                replaced |= kept < own
                kept = i
            if start < 0:
                states.append(kept)
                counts.append(len(final))
            elif states[i - own] == kept:
                return {"start": start, "prefix": final, "drop": counts[i - own], "end": states[-1], "replaced": replaced}
        if start < 0:
            common.extend(final)
        return {"start": start, "prefix": [] if start < 0 else final, "drop": 0 if start < 0 else len(common), "end": kept, "replaced": replaced}

    return common, [run(start) for start in range(-1, own)]


def thin(rows: DataFrame, keys: list[str], at: str, least: float | str, strength: str | None = None, block: float | None = None) -> DataFrame:
    """Keeps the first row of a key and each later one at least ``least`` after the last kept; with ``strength``, a closer
    row that is stronger than the last kept takes its place. ``least`` is a number or the name of a column that is
    constant in a key, at most ``block`` (by default 1024 times the number). Rows without a time take no part."""
    if block is None:
        if isinstance(least, str):
            raise ValueError("a column of distances needs a block")
        block = 1024 * max(least, 1e-9)
    apart = F.col(least) if isinstance(least, str) else F.lit(least)
    kinds = dict(rows.dtypes)
    kind = kinds[at]
    row, strong = f"struct<at: {kind}, strength: double>", F.col(strength).cast("double") if strength else F.lit(0.0)
    picked = rows.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("at"), strong.alias("strength"), apart.cast("double").alias("least"), F.floor(F.col(at) / block).alias("_b"))
    near = F.when(F.col("at") > (F.col("_b") + 1) * block - F.col("least"), F.col("_b") + 1)
    spread = picked.withColumn("block", F.explode(F.array_compact(F.array(F.col("_b"), near)))).withColumn("own", F.col("block") == F.col("_b")).drop("_b")

    def fold(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("own", "ascending"), ("at", "ascending"), ("strength", "ascending")])
        own, gap = int(pc.sum(pc.invert(part["own"])).as_py() or 0), part["least"][0].as_py()
        if gap > block:
            raise ValueError("a block must be at least as long as the distance")
        times, strengths = part["at"], part["strength"].fill_null(-np.inf).to_numpy()
        if own == len(part):
            return part.select(keys).slice(0, 0).append_column("block", pa.array([], pa.int64())).append_column("kept", pa.array([], _list(times.type))).append_column("outcomes", pa.array([], pa.list_(_outcome(times.type))))
        common, outcomes = fold_block(times.to_numpy(), strengths, own, gap)
        at_list, strength_list = times.to_pylist(), part["strength"].to_pylist()
        one = lambda i: {"at": at_list[i], "strength": strength_list[i]}
        told = [{"start": one(o["start"]) if o["start"] >= 0 else None, "prefix": [one(i) for i in o["prefix"]], "drop": o["drop"], "end": one(o["end"]), "inside": o["end"] >= own, "replaced": o["replaced"]} for o in outcomes]
        out = part.select(keys).slice(0, 1).append_column("block", pa.array([key[-1].as_py()], pa.int64()))
        return out.append_column("kept", pa.array([[one(i) for i in common]], _list(times.type))).append_column("outcomes", pa.array([told], pa.list_(_outcome(times.type))))

    names = [f"{k} {kinds[k]}" for k in keys]
    outcome = f"struct<start: {row}, prefix: array<{row}>, drop: int, end: {row}, inside: boolean, replaced: boolean>"
    folded = spread.groupBy(*keys, "block").applyInArrow(fold, ", ".join([*names, "block long", f"kept array<{row}>", f"outcomes array<{outcome}>"]))
    brief = F.transform("outcomes", lambda o: F.struct(o["start"].alias("start"), o["end"].alias("end"), o["replaced"].alias("replaced")))
    ordered = folded.select(*keys, "block", brief.alias("outcomes")).repartition(*keys).sortWithinPartitions(*keys, "block")
    chosen = ordered.mapInArrow(_chain(keys), ", ".join([*names, "block long", "choice int", "stays boolean"]))
    other = chosen.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("block").alias("_block"), "choice", "stays")
    same = F.col("block") == F.col("_block")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    picked = folded.join(other, same).withColumn("o", F.element_at("outcomes", F.col("choice") + 1))
    last = F.when(F.col("stays") & F.col("o.inside"), F.array("o.end")).otherwise(F.array().cast(f"array<{row}>"))
    final = F.concat("o.prefix", F.slice("kept", F.col("o.drop") + 1, F.size("kept")), last)
    found = picked.select(*keys, F.explode(final).alias("r"))
    return found.select(*keys, F.col("r.at").alias(at), *([F.col("r.strength").cast(kinds[strength]).alias(strength)] if strength else []))


def _row(kind: pa.DataType) -> pa.DataType:
    return pa.struct([("at", kind), ("strength", pa.float64())])


def _list(kind: pa.DataType) -> pa.DataType:
    return pa.list_(_row(kind))


def _outcome(kind: pa.DataType) -> pa.DataType:
    return pa.struct([("start", _row(kind)), ("prefix", _list(kind)), ("drop", pa.int32()), ("end", _row(kind)), ("inside", pa.bool_()), ("replaced", pa.bool_())])


def _chain(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Names each block's outcome from the one before, and whether the row kept last stays: blocks of a key in order."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # the block before: its key, number, end, and the row to give
        for batch in batches:
            out: list[list] = []
            values = [batch[k].to_pylist() for k in keys]
            for i, (block, outcomes) in enumerate(zip(batch["block"].to_pylist(), batch["outcomes"].to_pylist(), strict=True)):
                key, choice = [v[i] for v in values], 0
                if held:
                    if held[0] == key and held[1] == block - 1:
                        choice = next((j for j, o in enumerate(outcomes) if o["start"] == held[2]), 0)
                    out.append([*held[0], held[1], held[3], not outcomes[choice]["replaced"] or choice == 0])
                held = [key, block, outcomes[choice]["end"], choice]
            yield _rows(out, batch.schema, keys)
            schema = batch.schema
        if held:
            yield _rows([[*held[0], held[1], held[3], True]], schema, keys)

    return chain


def _rows(rows: list[list], schema: pa.Schema, keys: list[str]) -> pa.RecordBatch:
    kinds = [*(schema.field(k).type for k in keys), pa.int64(), pa.int32(), pa.bool_()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*keys, "block", "choice", "stays"])
