"""Hysteresis runs of a stream: state per key, event-time timers, late rows.

Rows may come in any order within the watermark. A key holds the rows that the watermark has not passed, and its open
run; a timer at the earliest of them fires when the watermark has passed it, and the rows up to the watermark then
move on in order of time. A run ends where a frame is missing or does not pass, and is given if one of its frames entered. What is later than
the watermark is dropped by Spark before it comes here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAME = "frame long, at long, enters boolean, stays boolean"


class Runs(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", FRAME)
        self.run = handle.getValueState("run", "start long, stop long, entered boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        new = [(r.frame, r.at, r.enters, r.stays) for r in rows]
        if new:
            waiting = [tuple(r) for r in self.waiting.get()]
            self.waiting.put([*waiting, *new])
            self._wake([*waiting, *new])
        return iter([])

    def _wake(self, waiting: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, (tuple, list)) else t)
        if waiting:
            self.handle.registerTimer(min(r[1] for r in waiting))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()]
        ready, rest = sorted(r for r in waiting if r[1] <= now), [r for r in waiting if r[1] > now]
        run = tuple(self.run.get()) if self.run.exists() else None
        done = []
        for frame, _, enters, stays in ready:
            if run and (frame > run[1] or not stays):
                done.append(run)
                run = None
            if stays:
                run = (run[0], frame + 1, run[2] or enters) if run else (frame, frame + 1, enters)
        if run:
            self.run.update(run)
        else:
            self.run.clear()
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self._wake(rest)
        return iter([Row(key=key[0], start=a, stop=b) for a, b, entered in done if entered])

    def close(self) -> None:
        pass


def hysteresis_stream(frames: DataFrame, key: str, frame: str, time: str, enter: Column, leave: Column, late: str = "10 minutes") -> DataFrame:
    """(key, start, stop) of each finished run, appended: frames in a row that pass ``leave``, one of which passes
    ``enter``. ``frame`` numbers the frames and ``time`` is their time; a frame comes once. Needs the RocksDB state store."""
    flags = {"enters": F.coalesce(enter, F.lit(False)), "stays": F.coalesce(leave, F.lit(False))}
    rows = frames.withWatermark(time, late).withColumns(flags).select(F.col(key).cast("string").alias("key"), F.col(frame).cast("long").alias("frame"), F.unix_millis(time).alias("at"), "enters", "stays", time)
    found = rows.groupBy("key").transformWithState(statefulProcessor=Runs(), outputStructType="key string, start long, stop long", outputMode="Append", timeMode="EventTime")
    return found.withColumnRenamed("key", key)
