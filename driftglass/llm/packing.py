"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. An example's demands are a vector in shares of
these limits; from a pool the example that fits with the largest dot product of its demands and the room left is placed
next, so long and short examples, or contexts and answers, meet in a sequence until all limits are used together. Where
nothing fits whole, or only one segment is left, the piece with the largest dot product is cut off an example and its
rest goes back to the pool. A sequence starts with the oldest example of the pool, so none waits for ever.

Each task packs the rows of its own partition as they stream by (no shuffle; memory is a pool of ``pool`` examples and
rows are moved by no more than the pool). A sequence that a limit or the end of the rows leaves short is split at powers
of two, which need no padding.

An example's first ``loss_from`` tokens bear no loss (an instruction before its answer): a column of counts, or the
share of each example that is context.

Edge cases: a null or blank text has the end id only; null or repeated ids are packed like others, each row on its own;
an empty table gives no rows; an example longer than a sequence is cut; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import trim
from .word_memo import memo_for

#: The share of an example that is context unless the caller says otherwise.
CONTEXT = 0.25
SCHEMA = "id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long, sequence_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 16
    loss: int = 3584


@dataclass
class _Example:
    id: int | None
    ids: bytes
    loss_from: int
    start: int = 0
    total: int = field(init=False)

    def __post_init__(self):
        self.total = len(self.ids) // 4

    @property
    def left(self) -> int:
        return self.total - self.start

    def loss(self, n: int) -> int:
        return max(0, self.start + n - max(self.start, self.loss_from))

    @property
    def free(self) -> int:
        """Tokens ahead that bear no loss."""
        return min(self.left, max(0, self.loss_from - self.start))


class Packer:
    """Packs a stream of examples; ``pack`` gives sequences, each a list of (example, start, length)."""

    def __init__(self, limits: Limits, pool: int):
        self.limits, self.size = limits, pool
        self.examples: list[_Example] = []
        self.need = np.zeros((pool, 3), np.int64)  # tokens left, those ahead without loss, and arrival of each example in the pool
        self.arrived = 0

    def _put(self, k: int, example: _Example) -> None:
        self.need[k, :2] = example.left, example.free

    def _drop(self, k: int) -> None:
        last = self.examples.pop()
        if k < len(self.examples):
            self.examples[k] = last
            self.need[k] = self.need[len(self.examples)]

    def _choice(self, tokens: int, segments: int, loss: int, opening: bool) -> tuple[int, int]:
        """(place in the pool, tokens to take) of what goes next; nothing to take: (0, 0)."""
        left, free, arrival = self.need[: len(self.examples)].T
        most = self.limits
        take = np.minimum(np.minimum(left, tokens), free + loss)
        if opening and take[k := int(arrival.argmin())]:
            return k, int(take[k])
        worth = take * (tokens / most.tokens**2) + np.maximum(take - free, 0) * (loss / most.loss**2) + segments / most.segments**2
        whole = take == left
        if segments > 1 and whole.any():
            worth = np.where(whole, worth, -1)
        k = int(worth.argmax())
        return k, int(take[k])

    def pack(self, stream: Iterator[_Example]) -> Iterator[list[tuple[_Example, int, int]]]:
        more = True
        while True:
            tokens, segments, loss = self.limits.tokens, self.limits.segments, self.limits.loss
            placed: list[tuple[_Example, int, int]] = []
            while tokens and segments:
                while more and len(self.examples) < self.size:
                    example = next(stream, None)
                    more = example is not None
                    if more:
                        self.examples.append(example)
                        self._put(len(self.examples) - 1, example)
                        self.need[len(self.examples) - 1, 2] = self.arrived = self.arrived + 1
                if not self.examples:
                    break
                k, n = self._choice(tokens, segments, loss, not placed)
                if not n:
                    break
                example = self.examples[k]
                placed.append((example, example.start, n))
                tokens, segments, loss = tokens - n, segments - 1, loss - example.loss(n)
                example.start += n
                if example.left:
                    self._put(k, example)
                else:
                    self._drop(k)
            if not placed:
                return
            yield from self._powers(placed) if tokens else [placed]

    @staticmethod
    def _powers(placed: list[tuple[_Example, int, int]]) -> Iterator[list[tuple[_Example, int, int]]]:
        """Cuts a sequence that stays short into some whose lengths are powers of two."""
        left, now, room = sum(n for *_, n in placed), [], 0
        for example, start, n in placed:
            while n:
                room = room or 1 << (left.bit_length() - 1)
                take = min(n, room)
                now.append((example, start, take))
                start, n, left, room = start + take, n - take, left - take, room - take
                if not room:
                    yield now
                    now = []


def pack_texts(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", loss_from: Column | float = CONTEXT, limits: Limits = Limits(), pool: int = 256, spaced: bool = False, remembered: int | None = None) -> DataFrame:
    """One row per piece: id, its start in the example, its ids (little-endian unsigned 32-bit), the example's length,
    and the sequence, offset and segment where it lies. ``tokenizer`` is the path of a tokenizers file. Workers remember
    words between tasks; with ``remembered``, about so many and only until the task ends."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        memo = memo_for(tokenizer, spaced, remembered)

        def examples() -> Iterator[_Example]:
            for batch in batches:
                rows = iter(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
                for ids, ends in memo.encode(batch.column(1), end_id):
                    low = 0
                    for high in ends.tolist():
                        key, first = next(rows)
                        yield _Example(key, ids[low:high].tobytes(), int(share * (high - low)) if first is None else first)
                        low = high

        sequence, out = TaskContext.get().partitionId() << 40, []
        for placed in Packer(limits, pool).pack(examples()):
            total, at = sum(n for *_, n in placed), 0
            for segment, (example, start, n) in enumerate(placed):
                loss = max(0, start + n - max(start, example.loss_from))
                out.append((example.id, start, example.ids[4 * start : 4 * (start + n)], example.total, sequence, at, segment, loss, total))
                at += n
            sequence += 1
            if len(out) >= 2000:
                yield _batch(out)
                out = []
        if remembered:
            memo.forget()
        if out:
            yield _batch(out)

    share = 0.0 if isinstance(loss_from, Column) else loss_from
    first = loss_from if isinstance(loss_from, Column) else F.lit(None)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), first.cast("int").alias("loss_from")).mapInArrow(rows, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["id", "start", "ids", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens", "sequence_tokens"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def violations(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The sequences of a packing that break a limit or have gaps, with what they hold; none in a sound packing."""
    sums = pieces.withColumn("n", F.octet_length("ids") / 4).groupBy("sequence_id").agg(F.sum("n").cast("long").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss"), F.max(F.col("offset") + F.col("n")).cast("long").alias("stop"), F.count_distinct("offset").alias("places"))
    return sums.where((F.col("tokens") > limits.tokens) | (F.col("segments") > limits.segments) | (F.col("loss") > limits.loss) | (F.col("stop") != F.col("tokens")) | (F.col("places") != F.col("segments"))).select("sequence_id", "tokens", "segments", "loss")
