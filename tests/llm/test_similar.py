from __future__ import annotations

import random

import pytest
import xxhash

from pyspark.sql import functions as F

from driftglass.llm import simhash, similar, stages


def test_similar_documents(spark):
    rng = random.Random(11)
    words = [f"wörd{i}" for i in range(400)]
    base, rows = [rng.choices(words, k=300) for _ in range(6)], []
    for i in range(90):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 40])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t), "en"))
    rows += [(100 + i, " ".join(rng.choices(words, k=200)), "en") for i in range(20)]
    rows += [(None, rows[0][1], "en"), (200, None, "en"), (201, "", "en"), (202, "short text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    sets = {i: grams(t or "") for i, t, _ in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in sets}


def _check_groups(spark, texts):
    """similar_documents against the closure of all pairs of Jaccard 0.8; how many pairs there are."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs).collect()}
    words = [t.split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    root, pairs = list(range(len(texts))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in range(len(texts))}
    return pairs


def _edited(rng, words, text, n):
    t = list(text)
    for k in rng.sample(range(len(t)), n):
        t[k] = rng.choice(words)
    return t


def test_every_pair_of_a_family_is_verified(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=120)
    family = []
    for _ in range(60):  # two by two alike, each pair too far from all others of the family
        t = _edited(rng, words, base, 4)
        family += [" ".join(t), " ".join(_edited(rng, words, t, 2))]
    rng.shuffle(family)
    monkeypatch.setattr(similar, "BLOCK", 32)
    assert _check_groups(spark, family) >= 60


def test_scattered_changes_are_found(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for k, edits in ((40, 1), (60, 1), (100, 2), (200, 4), (400, 8)):
        for _ in range(60):
            t = rng.choices(words, k=k)
            texts += [" ".join(t), " ".join(_edited(rng, words, t, edits))]
    assert _check_groups(spark, texts) >= 150


def test_equal_fingerprints_are_compared(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        t = [rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(240)]
        t[100:100] = ["-"] * 60
        texts.append(" ".join(t))
    assert _check_groups(spark, texts) == 0


def test_rows_are_not_named_by_a_hash(spark, monkeypatch):
    """With every hash of a row's columns equal, no row is taken for another."""

    class Same:
        def __getattr__(self, name):
            return getattr(F, name)

        def xxhash64(self, *columns):
            return F.lit(7) if len(columns) == 3 else F.xxhash64(*columns)

    monkeypatch.setattr(similar, "F", Same())
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", k=30))) for i in range(20)] + [(None, "without an id " * 5), (3, "the same id but another text " * 3), (19, "once more"), (19, "once more"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in similar.one_of_each(docs).collect()), key=str)
    assert got == sorted(set(rows), key=str)


def test_similar_texts_are_linked_by_simhash_first(spark, monkeypatch):
    """The pairs compared first are those of the SimHash operator's classes; what it links wrongly stays apart."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=300)) for _ in range(4)]
    texts += [t.replace(" ", "  ", 1) for t in texts[:3]] + [texts[0] + " end", ""]
    texts += [" ".join(["-"] * 200 + rng.choices([f"v{i}" for i in range(500)], k=40)) for _ in range(4)]  # filler fixes the bits
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.select(F.xxhash64("text").alias("node"), "text")
    node = [r.node for r in docs.orderBy("doc_id").select(F.xxhash64("text").alias("node")).collect()]
    prints = [simhash.fingerprint_of(t.encode(), 4, xxhash.xxh64_intdigest) for t in texts]
    near = lambda i, j: ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[j] for j in range(len(texts)) if near(i, j)) for i in range(len(texts))]
    least = {r: min(n for n, x in zip(node, root, strict=True) if x == r) for r in root}
    want = {(least[r], n) for n, r in zip(node, root, strict=True) if n != least[r]}
    assert {tuple(r) for r in similar.fingerprint_pairs(keyed).collect()} == want and len(want) == 4 + 3
    asked, operator = [], simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda *a, **k: asked.append(1) or operator(*a, **k))
    kept = {r.doc_id for r in stages.drop_near_duplicates(spark, docs, "").collect()}
    assert asked and kept == {0, 1, 2, 3, 8, 9, 10, 11, 12}


def test_texts_meet_in_passes(spark, monkeypatch):
    """However many pairs are open, a pass brings few texts together, and no link is lost between the passes."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=120)
    family = []
    for _ in range(15):
        t = _edited(rng, words, base, 4)
        family += [" ".join(t), " ".join(_edited(rng, words, t, 2))]
    saved, save = [], similar.Stage.save
    monkeypatch.setattr(similar.Stage, "save", lambda self, df, label: saved.append(label) or save(self, df, label))
    monkeypatch.setattr(similar, "SHARE", 0.3)
    assert _check_groups(spark, family) >= 15
    assert "star-links-1" in saved


def test_bitmaps_rule_out_no_similar_pair(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    texts = ["", "short text"]
    for k, edits in ((30, 1), (100, 2), (400, 8), (1200, 30)):
        for _ in range(4):
            t = rng.choices(words, k=k)
            texts += [" ".join(t), " ".join(_edited(rng, words, t, edits))]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    signed = docs.select("i", "text", similar.bitmaps(5)("text").alias("s"))
    other = signed.select(F.col("i").alias("j"), F.col("text").alias("other"), F.col("s").alias("o"))
    both = signed.crossJoin(other).where("i < j")
    judged = both.select((similar.jaccard(5)("text", "other") >= 0.8).alias("similar"), similar.bits_allow(0.8)("s.size", "s.bits", "o.size", "o.bits").alias("open"))
    n = {tuple(r[:2]): r[2] for r in judged.groupBy("similar", "open").count().collect()}
    assert (True, False) not in n and n[True, True] >= 8 and n[False, False] > 9 * n.get((False, True), 0)
