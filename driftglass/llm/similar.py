"""Texts of equal or similar sets of word shingles: SimHash first, then every pair of a Jaccard similarity.

The SimHash operator puts texts into classes by multi-index hashing, and each text is compared with the least one of its
class: fingerprints alone prove nothing, as a much repeated filler can fix all their bits. Pairs of the similarity that
lie beyond the fingerprints' radius are then found by an exact prefix filter, which compares no pair a second time.

Each text's shingles are put in one fixed order, common ones last. Two sets of similarity s share one of their first
floor((1 - s) n) + 1 shingles, so such texts meet in the bucket of a shingle, whatever else they hold; similarities are
then counted on the whole sets. One row per text, shingle of its prefix goes to Spark, sorted by shingle and read as a
stream, so a bucket of any size needs no memory. A shingle that stands in more than ``FEW`` prefixes of one slice of
texts sends one row from there; the slice's other rows for it are dealt by slice and meet the bucket's leader by a join.

In a bucket a text is first compared with one leader and, where that leaves more than one class, with ``LEADERS`` others
that stand in many buckets. Where classes are left, all pairs of texts outside the largest class and of another class
are compared: few of them as rows; many in tiles of bounded blocks. Bitmaps of the sets rule out most pairs before texts
meet, and what they leave open brings its texts together in passes of bounded size. The groups are therefore
the closure of all pairs of the similarity, up to clashes of 64-bit shingle hashes.

Edge cases: null and blank texts are equal and have one empty shingle; a text below the width is one shingle; texts are
told apart by 128 bits; null ids take part and are kept only where no row of their group has an id; rows that repeat
id and text are one; rows that share only their id are judged each by its text; an empty table gives no rows; other
columns stay as they are, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import Stage, connected_components, free_names, text_key
from .hashing import Hasher, mixed
from .memory import trim

#: Words of a SimHash shingle, and bits in which linked fingerprints differ at most: those of ``op8_simhash``.
FINGERPRINT_WORDS, RADIUS = 4, 4
#: Texts whose shingles are counted to find the common ones, and the most common ones that are put last. Any order
#: gives the same links.
SAMPLE, COMMON = 5_000, 100_000
#: Prefixes of a slice with the same shingle that are sent as rows of their own; and members of a bucket outside its
#: largest class up to which they are paired with the others as rows.
FEW = 8
#: Leaders of a bucket that is still apart after the first one.
LEADERS = 16
#: Texts on a side of a tile, and bits of their bitmaps.
BLOCK, BITS = 1024, 2048
#: Bytes of text that the pairs of a pass bring together, as a share of the bytes of all texts.
SHARE = 1.5
#: Bytes of text hashed together.
SLICE = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _word_hashes(data: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of the bytes."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return start, hasher.of(hasher.sums(_LOWER[data]), start, stop)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, next text, their bytes with a space after each, where each begins)."""
    texts = texts.cast(pa.large_binary())
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, "right")) - 1)
        data = np.insert(raw[bounds[at] : bounds[stop]], bounds[at + 1 : stop + 1] - bounds[at], 0x20)
        yield at, stop, data, bounds[at:stop] - bounds[at] + np.arange(stop - at)
        at = stop


def shingles(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, next text, distinct shingle hashes sorted within each text, the text of each)."""
    hasher = Hasher(1 << 16, 3)
    for first, stop, data, begin in _slices(texts):
        parts, at = [], 0
        while at < len(data):  # pieces end at white space
            end = min(at + len(hasher.up) - 1, len(data))
            while end < len(data) and not _SPACE[data[end - 1]] and end > at + 1:
                blank = np.flatnonzero(_SPACE[data[at:end]])
                if len(blank):
                    end = at + int(blank[-1]) + 1
                else:  # a word longer than all before
                    hasher = Hasher(2 * (len(hasher.up) - 1), 3)
                    end = min(at + len(hasher.up) - 1, len(data))
            start, h = _word_hashes(data[at:end], hasher)
            parts.append((start + at, h))
            at = end
        start, word = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in ((0, np.int64), (1, np.uint64)))
        owner = np.searchsorted(begin, start, "right") - 1
        count = np.bincount(owner, minlength=stop - first)
        lack = np.maximum(width - count, 0)  # short texts are filled up with no-words
        word = np.insert(word, np.repeat(np.cumsum(count), lack), np.uint64(0))
        count = count + lack
        ends = np.cumsum(count)
        total = np.zeros(max(len(word) - width + 1, 0), np.uint64)
        for k in range(width):
            total += mixed(word[k : k + len(total)] + np.uint64(k + 1))
        owner = np.repeat(np.arange(stop - first), count)[: len(total)]
        inside = np.arange(len(total)) + width <= ends[owner]
        h, owner = mixed(total[inside]), owner[inside]
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        yield first, stop, h[new].view(np.int64), owner[new]


def _prefixes(width: int, similarity: float, common: np.ndarray, count: np.ndarray):
    """Rows (h, node, meta, deal) of the first shingles of each set; meta is the set's size and the shingle's place.
    deal: 0 for a row of the bucket, 1 if it also speaks for others of its slice, else the slice's number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for begin, stop, h, owner in shingles(batch.column("text"), width):
                size = np.bincount(owner, minlength=stop - begin)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.lexsort((h, np.where(common[at] == h, count[at], 0), owner))]
                place = np.arange(len(h)) - (np.cumsum(size) - size)[owner]
                first = place <= (size - np.ceil(similarity * size - 1e-9))[owner]
                h, owner, place = h[first], owner[first], place[first]
                node = nodes[begin:stop][owner]
                order = np.lexsort((node, h))
                h, node, meta = h[order], node[order], (size[owner] << 32 | place)[order]
                same = np.zeros(len(h), bool)  # copies of a text in one slice
                same[1:] = (h[1:] == h[:-1]) & (node[1:] == node[:-1])
                h, node, meta = h[~same], node[~same], meta[~same]
                new = np.ones(len(h), bool)
                new[1:] = h[1:] != h[:-1]
                start = np.flatnonzero(new)
                of = np.diff(np.append(start, len(h)))
                crowd = np.repeat(of > FEW, of)
                deal = np.where(crowd, np.where(new, 1, 2 + (node[0] & 0xFFFFFF if len(node) else 0)), 0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, node, meta, deal)], names=["h", "node", "meta", "deal"])
        trim()

    return rows


_SHARED = "h long, node long, meta long, lead long, lead_meta long, kind int"


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that more than one text has, each with the first of its bucket. The rows come sorted by
    shingle and node. kind 1 tells the leader of a bucket that has more rows (kind 2) elsewhere."""
    names, lead, held = ["h", "node", "meta", "deal"], None, None  # lead: of the bucket read last; held: its only row

    def out(h, node, meta, lead_, lead_meta, kind):
        return pa.RecordBatch.from_arrays([*map(pa.array, (h, node, meta, lead_, lead_meta)), pa.array(kind, pa.int32())], names=[x.split()[0] for x in _SHARED.split(", ")])

    for batch in batches:
        h, node, meta, deal = (batch.column(n).to_numpy() for n in names)
        apart = deal > 1
        if apart.any():
            zero = np.zeros(int(apart.sum()), np.int64)
            yield out(h[apart], node[apart], meta[apart], zero, zero, np.full(len(zero), 2))
            h, node, meta, deal = (x[~apart] for x in (h, node, meta, deal))
        if held is not None:
            h, node, meta, deal = (np.concatenate(([a], b)) for a, b in zip(held, (h, node, meta, deal), strict=True))
            held = None
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        start = np.flatnonzero(new)
        of = np.diff(np.append(start, len(h)))
        group = np.repeat(np.arange(len(start)), of)
        leader, leader_meta, told = node[start], meta[start], node[start] != node[start + of - 1]
        if lead is not None and lead[0] == h[0]:
            leader[0], leader_meta[0], told[0] = lead[1], lead[2], True
        speaks = np.maximum.reduceat(deal, start) == 1
        told |= speaks
        if not told[-1]:
            held, lead = (h[-1], node[-1], meta[-1], deal[-1]), None
        else:
            lead = (h[-1], leader[-1], leader_meta[-1])
        t = told[group]
        t[1:] &= new[1:] | (node[1:] != node[:-1])
        yield out(h[t], node[t], meta[t], leader[group][t], leader_meta[group][t], np.zeros(int(t.sum()), np.int64))
        if speaks.any():
            yield out(h[start][speaks], leader[speaks], leader_meta[speaks], leader[speaks], leader_meta[speaks], np.ones(int(speaks.sum()), np.int64))


def _set_list(texts: pa.Array, width: int) -> pa.ListArray:
    values, sizes = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for first, stop, h, owner in shingles(texts, width):
        values.append(h)
        sizes.append(np.bincount(owner, minlength=stop - first))
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes)), pa.int32()), pa.array(np.concatenate(values)))


def shingle_sets(width: int):
    """The distinct hashes of each text's shingles, sorted as unsigned numbers."""

    def of(texts: pa.Array) -> pa.Array:
        return _set_list(texts, width)

    return F.arrow_udf(of, "array<long>")


def jaccard(width: int):
    """The similarity of two texts' sets of shingles."""

    def some(a: pa.Array, b: pa.Array) -> list[float]:
        sides, out = [], []
        for texts in (a, b):  # a leader's text comes many times in a row
            coded = texts.dictionary_encode()
            lists = _set_list(coded.dictionary, width)
            sides.append((lists.flatten().to_numpy(), lists.offsets.to_numpy(), coded.indices.to_numpy()))
        (x, xs, xi), (y, ys, yi) = sides
        for i, j in zip(xi.tolist(), yi.tolist(), strict=True):
            n, m = xs[i + 1] - xs[i], ys[j + 1] - ys[j]
            both = len(np.intersect1d(x[xs[i] : xs[i + 1]], y[ys[j] : ys[j + 1]], assume_unique=True))
            out.append(both / (n + m - both))
        return out

    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        found = pa.array([x for i in range(0, len(a), 400) for x in some(a.slice(i, 400), b.slice(i, 400))], pa.float64())
        trim()
        return found

    return F.arrow_udf(of, "double")


def bitmaps(width: int):
    """For each text the number of its shingles and ``BITS`` bits: whether an odd number of them falls on each. Two sets
    differ in no fewer shingles than their bitmaps in bits."""

    def of(texts: pa.Array) -> pa.Array:
        out, sizes = [], [np.zeros(0, np.int64)]
        for first, stop, h, owner in shingles(texts, width):
            odd = np.bincount(owner * BITS + (h & (BITS - 1)), minlength=(stop - first) * BITS) & 1
            out += [x.tobytes() for x in np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1)]
            sizes.append(np.bincount(owner, minlength=stop - first))
        trim()
        return pa.StructArray.from_arrays([pa.array(np.concatenate(sizes), pa.int32()), pa.array(out, pa.binary())], names=["size", "bits"])

    return F.arrow_udf(of, "struct<size: int, bits: binary>")


def bits_allow(similarity: float):
    """Whether two sets of these sizes and bitmaps can have the similarity."""

    def of(size: pa.Array, bits: pa.Array, other_size: pa.Array, other_bits: pa.Array) -> pa.Array:
        n, m = (x.to_numpy().astype(np.int64) for x in (size, other_size))
        need = np.ceil((n + m) * (similarity / (1 + similarity)) - 1e-6)
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(len(n), BITS // 64) for x in (bits, other_bits))
        return pa.array((np.minimum(n, m) >= need) & (np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= n + m - 2 * need))

    return F.arrow_udf(of, "boolean")


def _hopeful(similarity: float):
    """Pairs of a tile, one that asks and one that is asked, of different classes, that sizes, places and bitmaps leave
    open."""

    def tile(rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy(zero_copy_only=False).astype(bool)
        node, root, size, pos = (rows[n].to_numpy() for n in ("node", "root", "size", "pos"))
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(len(rows), -1)
        x, y, found = np.flatnonzero(asks), np.flatnonzero(~asks), [np.zeros((2, 0), np.int64)]
        for i in range(0, len(x), 16):
            k = x[i : i + 16, None]
            sizes = size[k] + size[y]
            need = np.ceil(sizes * (similarity / (1 + similarity)) - 1e-6)
            open_ = (root[k] != root[y]) & (np.minimum(size[k] - pos[k], size[y] - pos[y]) >= need)
            u, v = np.nonzero(open_)
            a, b = k[u, 0], y[v]
            differ = np.concatenate([np.bitwise_count(bits[a[j : j + 8192]] ^ bits[b[j : j + 8192]]).sum(1, dtype=np.int64) for j in range(0, len(a), 8192)] or [np.zeros(0, np.int64)])
            near = differ <= sizes[u, v] - 2 * need[u, v]
            found.append(np.stack((node[a[near]], node[b[near]])))
        pairs = np.concatenate(found, 1)
        trim()
        return pa.table({"a_node": pa.array(pairs[0]), "b_node": pa.array(pairs[1])})

    return tile


def fingerprint_pairs(keyed: DataFrame) -> DataFrame:
    """``(a, b)``: each text of ``keyed(node, text)`` that SimHash links to others, with the least one of its class."""
    found = simhash.near_duplicates(keyed, "node", "text", FINGERPRINT_WORDS, RADIUS)
    return found.where("node <> component_id").select(F.col("component_id").alias("a"), F.col("node").alias("b")).distinct()


def similar_texts(keyed: DataFrame, stage: Stage, shingle: int, similarity: float) -> DataFrame:
    """``(node, root)`` for every distinct text of ``keyed(node, text)`` that is linked to another."""
    spark = keyed.sparkSession
    near = stage.save(fingerprint_pairs(keyed), "near")
    total = max(1, keyed.count())
    sample = keyed.where(F.pmod(F.xxhash64("node"), F.lit(max(1, total // SAMPLE))) == 0).select(shingle_sets(shingle)("text").alias("s"))
    often = sample.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c >= 8").orderBy(F.desc("c"), "h").limit(COMMON).toArrow()
    order = np.argsort(often["h"].to_numpy())
    rows = keyed.mapInArrow(_prefixes(shingle, similarity, often["h"].to_numpy()[order], often["c"].to_numpy()[order]), "h long, node long, meta long, deal long")
    placed = rows.repartition("h", F.when(F.col("deal") > 1, F.col("deal")).otherwise(0)).sortWithinPartitions("h", "node")
    led = stage.save(placed.mapInArrow(_led, _SHARED), "led")
    size, pos = F.shiftright("meta", 32).cast("int").alias("size"), F.col("meta").bitwiseAND(0x7FFFFFFF).cast("int").alias("pos")
    leader = F.struct(F.col("lead").alias("node"), F.shiftright("lead_meta", 32).cast("int").alias("size"), F.col("lead_meta").bitwiseAND(0x7FFFFFFF).cast("int").alias("pos")).alias("lead")
    own = led.where("kind = 0").select("h", "node", size, pos, leader)
    leaders = led.where("kind = 1").groupBy("h").agg(F.first("lead").alias("lead"), F.first("lead_meta").alias("lead_meta"))
    apart = led.where("kind = 2").drop("lead", "lead_meta").join(leaders, "h").select("h", "node", size, pos, leader)
    shared = own.union(apart)

    def may(a: str, b: str) -> Column:  # holds in the bucket of the first shingle that a similar pair shares
        rest = F.least(F.col(f"{a}size") - F.col(f"{a}pos"), F.col(f"{b}size") - F.col(f"{b}pos"))
        return rest >= (F.col(f"{a}size") + F.col(f"{b}size")) * (similarity / (1 + similarity)) - 1e-6

    hopeful = shared.where((F.col("node") != F.col("lead.node")) & may("", "lead."))
    # of the leaders that a text meets, the one it meets most often; the others are met below if their classes differ
    met = hopeful.groupBy("node", F.col("lead.node").alias("lead")).agg(F.count("*").alias("n"))
    most = met.groupBy("node").agg(F.max(F.struct("n", "lead")).alias("m")).select(F.col("m.lead").alias("a"), F.col("node").alias("b"))
    known = near.select(F.col("a").alias("low"), F.col("b").alias("high"))  # a is the least one
    stars = stage.save(most.join(known, (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high")), "left_anti"), "stars")

    texts = stage.save(keyed.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")

    signs = stage.save(texts.select("node", F.octet_length("text").alias("bytes"), bitmaps(shingle)("text").alias("sign")).select("node", "bytes", "sign.*"), "bitmaps")
    held = signs.agg(F.sum("bytes")).first()[0] or 0

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose texts are similar, stored; sets are made where the texts meet, as they are larger than the
        texts. A text comes once for each of its pairs, so they come in passes, whose shuffles are deleted in between."""
        one = pairs.join(signs.select(F.col("node").alias("b"), "bytes", "size", "bits"), "b")
        both = one.join(signs.select(F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("bits").alias("a_bits")), "a")
        open_ = stage.save(both.where(bits_allow(similarity)("size", "bits", "a_size", "a_bits")).select("a", "b", "bytes"), f"{name}-open")
        n, brought = open_.agg(F.count("*"), F.sum("bytes")).first()
        passes = math.ceil((brought or 0) / max(1.0, SHARE * held)) or min(1, n)
        found = []
        for k in range(passes):
            some = open_.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == k).select("a", "b")
            one = some.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
            both = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
            found.append(stage.save(both.where(jaccard(shingle)("x", "y") >= similarity).select("a", "b"), f"{name}-{k}"))
        return reduce(DataFrame.union, found) if found else open_.select("a", "b")

    links = verified(near.union(stars), "star-links")

    def classes_of(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """The rows of buckets that hold more than one class: with the largest one, all members and those outside it."""
        roots = connected_components(links, Stage(spark, f"similar-{name}"))
        classed = stage.save(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), f"classed-{name}")
        classes = classed.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "root")).alias("most"), F.sum("c").alias("all"))
        open_ = classes.where("most.c < all").select("h", F.col("most.root").alias("most"), F.col("all").alias("n"), (F.col("all") - F.col("most.c")).alias("minor"))
        left = stage.save(classed.join(open_, "h"), f"open-{name}")
        stage.drop(f"classed-{name}")
        return left

    def fresh(met: DataFrame, *before: DataFrame) -> DataFrame:
        """Pairs that were not compared before."""
        pairs = met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
        for old in before:
            pairs = pairs.join(old.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        return pairs

    bare = shared.drop("lead")
    left = classes_of(bare, links, "stars")
    stage.drop("led")
    # the members that stand in most buckets have the fewest shingles of their own: more leaders for what is still apart
    weight = left.groupBy("node").agg(F.count("*").alias("w"))
    weighted = left.join(weight, "node")
    deal = F.pmod(F.xxhash64("node", F.lit("leader")), F.lit(LEADERS))
    tops = [F.max(F.when(deal == r, F.struct("w", F.col("node").alias("a_node"), F.col("root").alias("a_root"), F.col("size").alias("a_size"), F.col("pos").alias("a_pos")))).alias(f"l{r}") for r in range(LEADERS)]
    leaders = weighted.groupBy("h").agg(*tops).select("h", F.explode(F.filter(F.array(*(f"l{r}" for r in range(LEADERS))), lambda x: x.isNotNull())).alias("l")).select("h", "l.*")
    side = lambda df, p: df.select("h", *(F.col(c).alias(f"{p}{c}") for c in ("node", "root", "size", "pos", "most")))
    met = side(left, "b_").join(leaders, "h").where((F.col("a_root") != F.col("b_root")) & may("a_", "b_"))
    more = stage.save(fresh(met, near, stars), "leader-pairs")
    links = links.union(verified(more, "leader-links"))
    left = classes_of(left.select(bare.columns), links, "leaders")
    stage.drop("open-stars")
    few = left.where(F.col("minor") <= FEW)
    met = side(few.where("root <> most"), "a_").join(side(few, "b_"), "h")
    met = met.where((F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("b_most")) | (F.col("a_node") < F.col("b_node"))) & may("a_", "b_"))
    pairs = stage.save(fresh(met, near, stars, more), "pairs")
    found = verified(pairs, "pair-links")
    many = left.where(F.col("minor") > FEW)
    block = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    mine, every = lambda n: F.pmod(F.xxhash64("node"), block(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), block(n) - 1))
    columns = ("node", "root", "size", "pos")
    asking = many.where("root <> most").select("h", mine("minor").alias("i"), every("n").alias("j"), F.lit(True).alias("asks"), *columns)
    asked = many.select("h", every("minor").alias("i"), mine("n").alias("j"), F.lit(False).alias("asks"), *columns)
    tiles = asking.union(asked).join(signs.select("node", "bits"), "node").groupBy("h", "i", "j").applyInArrow(_hopeful(similarity), "a_node long, b_node long")
    last = stage.save(fresh(tiles, near, stars, more, pairs), "tile-pairs")
    stage.drop("open-leaders")
    tiled = verified(last, "tile-links")
    stage.drop("texts")
    stage.drop("bitmaps")
    return connected_components(links.union(found).union(tiled), stage)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row with an id: the id and ``component_id``, linking texts whose sets of ``shingle``-word
    shingles have at least this Jaccard similarity."""
    stage = Stage(docs.sparkSession, "similar")
    rows = docs.where(F.col(id_col).isNotNull())
    keyed = rows.select(F.col(id_col).alias("id"), text_key(rows, text_col, stage).alias("node"), F.coalesce(text_col, F.lit("")).alias("text"))
    roots = similar_texts(keyed.select("node", "text"), stage, shingle, similarity)
    marked = keyed.select("id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = marked.groupBy("root").agg(F.min("id").alias("component_id"))
    return marked.join(named, "root").select(F.col("id").alias(id_col), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Exactly one row of each group of similar texts: the one with the smallest id, null ids last.

    A row is named by its id and its text's key themselves, not by a hash of them."""
    stage = Stage(docs.sparkSession, "similar")
    node, names = text_key(docs, text_col, stage), free_names(docs, "node", "null", "id", "kept_node", "kept_null", "kept_id")
    roots = similar_texts(docs.select(node.alias("node"), F.coalesce(text_col, F.lit("")).alias("text")), stage, shingle, similarity)
    first = docs.select(node.alias("node"), F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), node.alias("node")).alias("k")).groupBy("node").agg(F.min("k").alias("k"))
    kept = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k"))
    # plain columns, so that the rows are dealt once for the join and for what repeats
    parts = lambda node, id_: (node, id_.isNull(), F.coalesce(id_.cast("string"), F.lit("")))
    of_row, of_kept = names[:3], names[3:]
    kept = kept.select(*(c.alias(n) for c, n in zip(parts(F.col("k.node"), F.col("k.id")), of_kept, strict=True)))
    named = docs.withColumns(dict(zip(of_row, parts(node, F.col(id_col)), strict=True)))
    match = F.lit(True)
    for a, b in zip(of_row, of_kept, strict=True):
        match &= F.col(a) == F.col(b)
    return named.join(kept, match, "left_semi").dropDuplicates(of_row).select(docs.columns)
