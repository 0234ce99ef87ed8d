from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from driftglass.llm import periodic, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lyndon(v):
    """From each place to the next smaller suffix."""
    out = []
    for i in range(len(v)):
        j = i + 1
        while j < len(v) and not v[j:] < v[i:]:
            j += 1
        out.append(j - i)
    return out


def runs(words, exponent=4, shortest=6):
    """Every stretch of each period, and of those the ones that no smaller period has."""
    n, by_span = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q) and not any(s <= i and e >= j + q and q % p == 0 for (s, e), p in by_span.items()):
                by_span[i, j + q] = q
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in by_span.items())


def sequences(r, n):
    for _ in range(n):
        v = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 30))]
        if r.random() < 0.6:
            root = [r.randrange(3) for _ in range(r.randint(1, 5))]
            at = r.randint(0, len(v))
            v[at:at] = (root * 9)[: r.randint(1, 9 * len(root))]
        yield v


@pytest.mark.parametrize("seed", range(3))
def test_lyndon_arrays_and_runs(seed):
    r = random.Random(seed)
    for v in sequences(r, 1_500):
        values = np.array(v, np.int64)
        for sign in (1, -1):
            assert periodic.lyndon_lengths(sign * values).tolist() == lyndon([sign * x for x in v])
        for exponent, shortest in ((2, 2), (3, 5), (4, 6)):
            assert periodic.runs_of(values, exponent, shortest) == runs(v, exponent, shortest)


def test_stretches_lose_no_run():
    r = random.Random(9)
    for _ in range(100):
        texts = [[b"%d" % (x + 3 * r.randrange(4) * (r.random() < 0.1)) for x in v] for v in sequences(r, 8)]
        assert periodic.find_in(texts, 4, 6) == [runs(t) for t in texts]
        assert periodic.find_in(texts, 2, 2) == [runs(t, 2, 2) for t in texts]


def test_long_texts():
    r = random.Random(1)
    period = [b"%d" % i for i in range(5_000)]
    words = [b"x"] * 7 + period * 5 + period[:100] + [b"z%d" % r.randrange(40) for _ in range(60_000)] + [b"a", b"a", b"b"] * 30_000
    found = periodic.find_in([words], 4, 6)[0]
    assert (0, 7, 1) in found and (7, 25_100, 5_000) in found
    assert any(q == 3 and n >= 90_000 for _, n, q in found)
    assert periodic.find_in([[b"w"] * 300_000], 4, 6) == [[(0, 300_000, 1)]]


def test_collapsed():
    words = [b"a", b"b", b"b", b"b", b"b", b"b", b"b", b"c"]
    assert periodic.collapsed(words, runs(words)) == b"a b c"


def test_operator_edges(spark):
    told = "go on " * 5
    rows = [(1, told), (None, told), (1, told), (2, None), (3, " \t\n"), (4, "a\x0bb\x0cc  d"), (5, "é " * 6), (6, "    " * 4), (7, "x y " * 50_000)]
    docs = spark.createDataFrame([(i, t, "r", "w") for i, t in rows], "doc_id long, text string, runs string, id string").repartition(3)
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect()), key=str)
    words = lambda t: WORDS.findall(t or "")
    want = [(i, len(words(t)), runs(words(t)) if len(t or "") < 1000 else [(0, 100_000, 2)], " ".join(words(t)) if len(words(t)) < 6 else {"g": "go on", "é": "é", " ": " ", "x": "x y"}[t[0]]) for i, t in rows]
    assert got == sorted(want, key=str)
    assert periodic.find_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="repeats"):
        periodic.find_runs(docs, exponent=1)


def expected(doc_id, text):
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    top = min(((-length, s, q) for s, length, q in found), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = (None,) * 4 if top is None else (top[1], -top[0], top[2], -1000 * top[0] // top[2])
    return (doc_id, len(found), *first, digest("".join(f"{s},{length},{q}\n" for s, length, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query(spark, tmp_path):
    """The query over documents with planted periods, blank ones and null ids among them."""
    source = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in source if len(r["text"] or "") < 6_000]
    planted = [i for i in range(1_000, 9_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += [(i, " ".join(f"v{(i * j * j) % 50}" for j in range(i % 240))) for i in planted[:150]] + [(planted[150], None), (planted[151], " "), (planted[152], "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {expected(i, t) for i, t in rows}
    spark.createDataFrame([(None, "a a a a a a a")], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_periodic_runs(spark, str(tmp_path)).collect()[0].n_runs == 1
