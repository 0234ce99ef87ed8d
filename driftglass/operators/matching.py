"""Order-dependent matching of two event trains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import bursts


def match_trains(reference: np.ndarray, test: np.ndarray, within: float) -> tuple[int, int, int, float]:
    """(matched, lost, added, largest shift): in time order each reference event takes the nearest test event that is
    free, the earlier of equals, if it is within the tolerance."""
    test_, low, taken, shift = sorted(test.tolist()), 0, set(), 0.0
    for t in sorted(reference.tolist()):
        while low < len(test_) and test_[low] < t - within:
            low += 1
        best, k = None, low
        while k < len(test_) and test_[k] <= t + within:
            away = abs(test_[k] - t)
            if k not in taken and away <= within and (best is None or away < best[0]):
                best = (away, k)
            k += 1
        if best:
            taken.add(best[1])
            shift = max(shift, best[0])
    return len(taken), len(reference) - len(taken), len(test_) - len(taken), float(shift)


def greedy_train_match(reference: DataFrame, test: DataFrame, keys: list[str], within: float, block: float | None = None) -> DataFrame:
    """Per key of either side: matched, lost, added and shift. The trains are cut at gaps above the tolerance, which no
    match crosses; only bursts that hold events of both sides are matched, sorted and one after another as they stream
    by; the others are counted. Gaps are found in blocks of time, 64 tolerances long unless told."""
    both = reference.select(*keys, "t", F.lit(0).alias("side")).unionByName(test.select(*keys, "t", F.lit(1).alias("side")))
    cut = bursts(both, keys, "t", lambda gap: gap > within, block or 64 * max(within, 1e-9))
    whole = Window.partitionBy(*keys, "_burst")
    cut = cut.withColumn("mixed", F.min("side").over(whole) < F.max("side").over(whole))
    names = [*keys, "_burst"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, schema, found = None, ([], []), None, []

        def done() -> None:
            if now is not None:
                found.append([*now[:-1], *match_trains(np.array(sides[0]), np.array(sides[1]), within)])

        for batch in batches:
            schema = batch.schema
            for *burst, t, side in zip(*(batch[n].to_pylist() for n in [*names, "t", "side"]), strict=True):
                if burst != now:
                    done()
                    now, sides = burst, ([], [])
                sides[side].append(t)
            yield _batch(found, schema)
            found.clear()
        done()
        if found:
            yield _batch(found, schema)

    def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        kinds = [*(schema.field(k).type for k in keys), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*keys, "matched", "lost", "added", "shift"])

    kinds = dict(reference.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["matched long", "lost long", "added long", "shift double"])
    met = cut.where("mixed").select(*names, "t", "side").repartition(*names).sortWithinPartitions(*names, "t").mapInArrow(match, schema)
    alone = cut.where("not mixed").groupBy(*keys).agg(F.lit(0).cast("long").alias("matched"), F.count_if(F.col("side") == 0).alias("lost"), F.count_if(F.col("side") == 1).alias("added"), F.lit(0.0).alias("shift"))
    parts = met.unionByName(alone).groupBy(*keys)
    return parts.agg(*(F.sum(n).alias(n) for n in ("matched", "lost", "added")), F.max("shift").alias("shift"))
