from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from driftglass.llm import simhash
from driftglass.llm.common import Stage


def _brute_fp(text, width=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def _components(values, distance):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}é" for i in range(300)]
    rows, base = [], [rng.choices(words, k=200) for _ in range(12)]
    for i in range(120):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t).upper() if i % 5 == 0 else "\t".join(t), "x"))
    rows += [(200, None, "x"), (201, "", "y"), (202, " \n", "z"), (203, "one two", "z"), (203, "one two", "z"), (None, "one two", None), (204, "Ünï " * 40_000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {i: _brute_fp(t) for i, t, _ in rows}
    root = _components(sorted(set(fps.values())), 4)
    least = {}
    for i, f in fps.items():
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    for r in got:
        assert r.fp % 2**64 == fps[r.doc_id] and r.component_id == least[root[fps[r.doc_id]]]


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(simhash.hex_fingerprint(simhash.fingerprint(F.lit("A b"))).alias("x"), F.xxhash64(F.lit("a b")).alias("h")).first()
    assert int(row.x, 16) == row.h % 2**64 == _brute_fp("A b")


def test_dense_parts_are_tiled(spark):
    rng = np.random.default_rng(3)
    center = [int(x) for x in rng.integers(0, 2**62, 3)]
    values = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for c in center for _ in range(150)}
    values = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    stage = Stage(spark, "test")
    want = _components([v % 2**64 for v in values], 4)
    for segments, dense in ((3, 8), (3, 10**6), (4, 8), (2, 8)):
        pairs = simhash.near_pairs(fps, stage, 4, segments, dense).collect()
        have = {v: v for v in want}

        def find(x, have=have):
            while have[x] != x:
                x = have[x]
            return x

        for a, b in ((p.a % 2**64, p.b % 2**64) for p in pairs):
            assert (a ^ b).bit_count() <= 64
            have[find(a)] = find(b)
        groups = lambda f: {frozenset(v for v in want if f(v) == r) for r in {f(v) for v in want}}
        assert groups(find) == groups(want.get)


def test_tiles_are_bounded_on_both_sides(spark, monkeypatch):
    """Few hold a part and many ask for it: no tile sees many of either."""

    def sizes(_):
        import pyarrow as pa

        def of(rows):
            asks = rows["asks"].to_pylist()
            return pa.table({"a": [sum(asks)], "b": [len(asks) - sum(asks)]})

        return of

    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "_tile", sizes)
    # 20 share a part of 32 bits; 700 others have it but for one bit, each another part beside it
    values = [i << 32 for i in range(1, 21)] + [((1000 + i) << 32) | 1 << (i % 32) for i in range(700)]
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    plain = simhash.near_pairs(fps, Stage(spark, "test"), 2, 2, 10).where("a < 1000 and b < 1000").collect()
    assert sum(r.a for r in plain) >= 700 and max(r.a for r in plain) <= 64 and max(r.b for r in plain) <= 64


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


def test_parts_follow_the_size():
    assert simhash.cheapest_parts(10**5, 8) > simhash.cheapest_parts(10**9, 8) >= 2
