"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into ``segments`` parts, as many as are cheapest for the number of fingerprints. Two fingerprints at most ``max_distance`` bits apart differ by at
most ``max_distance // segments`` bits in one part, so each fingerprint asks a table of parts for a small Hamming ball
around each of its own parts, and the complete distance of every match is verified. Of a pair, only the side whose
lowest flipped bit is 0 asks, which halves the questions.

Parts that more than ``dense`` distinct fingerprints share (families of near copies) are not joined pair by pair:
their members are dealt into tiles, each tile compares blocks of fingerprints with XOR and returns a spanning forest.

Edge cases: null or blank texts have fingerprint zero and are linked like others; texts below the shingle length are
one shingle; rows with equal fingerprints are one node; rows with a null id take part and are never a component's
name, which is null where a whole component has no id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, connected_components

BITS = 64
TILE = 1024


def fingerprint_of(text: bytes, width: int, hash64) -> int:
    """Majority of the shingles' XXH64 bits; the bytes are UTF-8 and A-Z are lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [hash64(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [hash64(joined[s:e], 42) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], ">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: Column, width: int = 4) -> Column:
    """A text column's fingerprints as longs."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        import xxhash

        values = texts.cast(pa.large_binary()).to_pylist()
        return pa.array([fingerprint_of(x or b"", width, xxhash.xxh64_intdigest) for x in values], pa.int64())

    return of(text)


def _parts(segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each part."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _balls(segments: int, radius: int) -> list[tuple[int, int, int, int]]:
    """(part, shift, mask of the part, flipped bits) for every question a fingerprint asks."""
    return [(s, shift, (1 << width) - 1, sum(1 << b for b in bits)) for s, (shift, width) in enumerate(_parts(segments)) for d in range(radius + 1) for bits in combinations(range(width), d)]


def _asked(fps: DataFrame, balls: list[tuple[int, int, int, int]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(s).cast("long").alias("s"), F.lit(shift).alias("shift"), F.lit(mask).cast("long").alias("mask"), F.lit(flip).cast("long").alias("flip")) for s, shift, mask, flip in balls))
    spread = fps.select("fp", F.explode(rows).alias("q"))
    value = F.expr("shiftrightunsigned(fp, q.shift)").bitwiseAND(F.col("q.mask"))
    low = F.col("q.flip").bitwiseAND(-F.col("q.flip"))
    # the side whose lowest flipped bit is 0 asks; exact parts are asked by both, and ordered at the join
    return spread.where(value.bitwiseAND(low) == 0).select("fp", "q.flip", (F.col("q.s") * (1 << 40) + value.bitwiseXOR(F.col("q.flip"))).alias("key"))


def cheapest_parts(n: int, max_distance: int) -> int:
    """The number of parts with the least work for ``n`` fingerprints: questions asked, and a twentieth of one for each
    chance match of a question. Any number gives the same links."""

    def cost(segments: int) -> float:
        asked = len(_balls(segments, max_distance // segments)) / 2 + segments / 2
        return asked * (1 + 0.05 * n / 2 ** (BITS / segments))

    return min((m for m in range(2, 9) if max_distance // m <= 2 or m == 8), key=cost)


def _tile(max_distance: int):
    def tile(rows: pa.Table) -> pa.Table:
        fp, asks = rows["fp"].to_numpy().view(np.uint64), rows["asks"].to_numpy(zero_copy_only=False)
        kept, asked = np.unique(fp[~asks]), np.unique(fp[asks])
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        if len(kept) and len(asked):
            near = np.concatenate([np.bitwise_count(asked[i : i + TILE, None] ^ kept[None, :]) <= max_distance for i in range(0, len(asked), TILE)])
            far, label = len(kept), np.arange(len(kept))
            while True:
                of_asked = np.where(near, label[None, :], far).min(1)
                lower = np.minimum(label, np.where(near, of_asked[:, None], far).min(0))
                if (lower == label).all():
                    break
                label = lower
            hit = of_asked < far
            ends = [(asked[hit], kept[of_asked[hit]]), (kept, kept[label])]
        a, b = (np.concatenate([x[i] for x in ends]).view(np.int64) if ends else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"a": a[a != b], "b": b[a != b]})

    return tile


def near_pairs(fps: DataFrame, stage: Stage, max_distance: int = 4, segments: int = 3, dense: int = 64) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp`` whose closure is that of all pairs within ``max_distance``;
    all such pairs, where no part is shared by over ``dense`` fingerprints."""
    index = _asked(fps, [(s, shift, mask, 0) for s, shift, mask, flip in _balls(segments, 0)]).drop("flip")
    asked = _asked(fps, _balls(segments, max_distance // segments))
    crowded = stage.save(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > dense), "crowded")
    some = not crowded.isEmpty()
    rest = index.join(crowded, "key", "left_anti") if some else index
    pairs = (
        rest.select("key", F.col("fp").alias("a"))
        .join(asked.select("key", "flip", F.col("fp").alias("b")), "key")
        .where((F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance) & ((F.col("flip") != 0) | (F.col("a") < F.col("b"))))
        .select("a", "b")
    )
    if not some:
        return pairs
    # both sides of a tile are cut by their own counts: those who ask may be many more than those who hold
    asking = stage.save(asked.join(crowded, "key", "left_semi").groupBy("key").agg(F.count("*").alias("m")), "asking")
    sizes = crowded.join(asking, "key")
    block = lambda n: F.ceil(F.col(n) / TILE).cast("int")
    mine, every = lambda n: F.pmod(F.xxhash64("fp"), block(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), block(n) - 1))
    kept = index.join(sizes, "key").select("key", mine("n").alias("i"), every("m").alias("j"), "fp", F.lit(False).alias("asks"))
    ask = asked.join(sizes, "key").select("key", every("n").alias("i"), mine("m").alias("j"), "fp", F.lit(True).alias("asks"))
    tiles = kept.union(ask).groupBy("key", "i", "j").applyInArrow(_tile(max_distance), "a long, b long")
    return pairs.union(tiles)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_distance: int = 4, segments: int | None = None) -> DataFrame:
    """One row per input row: the id, ``fp`` (long) and ``component_id``, the smallest id reachable by links."""
    stage = Stage(docs.sparkSession, "simhash")
    marked = stage.save(docs.select(id_col, fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    nodes = stage.save(marked.groupBy("fp").agg(F.min(id_col).alias("_least")), "nodes")
    n = nodes.count()
    parts = segments or cheapest_parts(n, max_distance)
    # tiles are for families of near copies: more than chance puts into a part
    chance = n / 2 ** (BITS // parts)
    links = stage.save(near_pairs(nodes.select("fp"), stage, max_distance, parts, max(64, int(8 * chance))), "pairs")
    roots = connected_components(links, stage)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    table = stage.save(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return marked.join(table, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
