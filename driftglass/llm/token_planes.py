"""Token ids in files of shuffled planes.

Rows are range-partitioned by id and encoded in that order; each task cuts its ids into blocks of ``BLOCK``. A block is
transposed into planes (all first bytes of its ids, all second bytes, ...; or all first bits, ...) and each plane is
compressed with zstandard: high planes of small ids are constant and vanish. The file format is Parquet with a row per
block: part, block, first (ids of the part before it), n, the compressed planes, and the chunk index - which piece of
which document lies where - so that any block can be read on its own and by any Spark reader.

Edge cases: a null text is its end id only; rows with null or repeated ids are kept, ordered by id (nulls first) and
then by the hash of the text; an empty table gives an empty file; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage
from .memory import trim
from .word_memo import memo_for

BLOCK = 1 << 16
PIECE = pa.struct([("doc", pa.int64()), ("id", pa.int64()), ("doc_start", pa.int64()), ("doc_tokens", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
SCHEMA = "part int, block long, first long, n int, bits boolean, planes array<binary>, pieces array<struct<doc: long, id: long, doc_start: long, doc_tokens: long, at: long, n: long>>"


def to_planes(ids: np.ndarray, bits: bool, level: int = 3) -> list[bytes]:
    """The compressed planes of unsigned 32-bit ids, the lowest first."""
    import zstandard

    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1) if bits else raw.T
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(p.tobytes()) for p in np.ascontiguousarray(planes)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    raw = np.stack([np.frombuffer(unpack.decompress(p), np.uint8) for p in planes])
    if bits:
        raw = np.packbits(np.unpackbits(raw, axis=1, count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(raw.T).view("<u4").ravel()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", bits: bool = False, spaced: bool = True) -> None:
    """Encodes every text, appends the end id, and writes the blocks to ``path`` in ascending order of ids."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        memo, part = memo_for(tokenizer, spaced), TaskContext.get().partitionId()
        block, first, held, size, pieces, doc, start = 0, 0, [], 0, [], 0, 0

        def done(n: int) -> pa.RecordBatch:
            row = [[part], [block], [first], [n], [bits], [to_planes(np.concatenate(held), bits)], [pieces]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.binary()), pa.list_(PIECE)]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "first", "n", "bits", "planes", "pieces"])

        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for ids, ends in memo.encode(batch.column(1), end_id):
                low = 0
                for high in ends.tolist():
                    key, total, at = next(keys), high - low, 0
                    while at < total:
                        take = min(total - at, BLOCK - size)
                        held.append(ids[low + at : low + at + take])
                        pieces.append({"doc": doc, "id": key, "doc_start": start, "doc_tokens": total, "at": at, "n": take})
                        at, size = at + take, size + take
                        if size == BLOCK:
                            yield done(size)
                            block, first, held, size, pieces = block + 1, first + size, [], 0, []
                    doc, start, low = doc + 1, start + total, high
        if size:
            yield done(size)

    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    ordered.mapInArrow(blocks, SCHEMA).write.option("compression", "none").parquet(path)


def _times(operator: list[int], crc: int) -> int:
    out = 0
    for column in operator:
        if crc & 1:
            out ^= column
        crc >>= 1
    return out


@cache
def _zeros(power: int) -> list[int]:
    """The operator that carries a CRC-32 over 2**power zero bits, as 32 columns."""
    if not power:
        return [0xEDB88320, *(1 << i for i in range(31))]  # CRC-32's polynomial, reflected
    half = _zeros(power - 1)
    return [_times(half, column) for column in half]


def combined(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings in a row from theirs and the second's size: the first is carried over ``size``
    zero bytes."""
    bits = 8 * size
    for power in range(bits.bit_length()):
        if bits >> power & 1:
            first = _times(_zeros(power), first)
    return first ^ second


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of each block with the CRC-32 of their ids."""
    for batch in batches:
        part, n, bits, planes = (batch.column(i).to_pylist() for i in range(4))
        lists = batch.column(4)
        pieces, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
        crc, at = [], np.cumsum(count) - count
        stops = pieces.field("n").to_numpy()
        for i in range(len(part)):
            ids, low = memoryview(from_planes(planes[i], n[i], bits[i]).tobytes()), 0
            for k in stops[at[i] : at[i] + count[i]].tolist():
                crc.append(zlib.crc32(ids[4 * low : 4 * (low + k)]))
                low += k
        names = ["doc", "id", "doc_start", "doc_tokens", "at", "n"]
        columns = [pa.array(np.repeat(part, count), pa.int32()), *(pieces.field(x) for x in names), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", *names, "crc"])


def _one_crc(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("at")
    crc = 0
    for n, c in zip(rows["n"].to_pylist(), rows["crc"].to_pylist(), strict=True):
        crc = combined(crc, c, 4 * n)
    last = rows.slice(0, 1)
    return last.set_column(last.schema.get_field_index("crc"), "crc", pa.array([crc], pa.int64()))


def read_digests(spark: SparkSession, path: str, stage: Stage) -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens and the CRC-32 of its ids."""
    blocks = spark.read.parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n").alias("ids"))
    # one row for each part written
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    schema = "part int, doc long, id long, doc_start long, doc_tokens long, at long, n long, crc long"
    pieces = stage.save(blocks.select("part", "n", "bits", "planes", "pieces").mapInArrow(_pieces, schema), "pieces")
    whole = pieces.where("n = doc_tokens")
    cut = pieces.where("n < doc_tokens").groupBy("part", "doc").applyInArrow(_one_crc, schema)
    return whole.union(cut).join(offsets, "part").select("id", (F.col("before") + F.col("doc_start")).alias("start"), F.col("doc_tokens").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
