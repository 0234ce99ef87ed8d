from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from driftglass.llm import lexical, queries

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document scored for every item."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(times * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def made(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, n int").repartition(5)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, query int")
    return d, q


def test_terms():
    for text in ("Ab-c_D é中 x1\x7f\u0080ÀA", "", None, "..", "ÄÖ ßA B"):
        assert [t.decode() for t in lexical.terms_of(text)] == terms(text)


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_brute_force(spark, monkeypatch, seed):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(400)] + ["Ünï", "ZZ"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, text(r.choice([0, 1, 5, 40, 400]))) for i in range(200)]
    docs += [(None, "w1 w2"), (7, "w1 w2"), (7, "w1 w2"), (500, None), (501, " .. "), (502, text(9000))] + [(600 + i, "same text w3 w5") for i in range(40)]
    items = [(i, text(r.choice([1, 3, 30]))) for i in range(30)] + [(90, None), (91, "nowhere"), (92, "same text"), (92, "w3"), (None, "w5 w5 w1"), (93, "ZZ zz Zz")]
    monkeypatch.setattr(lexical, "SLICE", 3_000)
    monkeypatch.setattr(lexical, "CELLS", 500)
    if seed % 2:
        monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
        monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    assert rows_of(lexical.search(*made(spark, docs, items))) == brute(docs, items)


def test_empty_tables(spark):
    assert rows_of(lexical.search(*made(spark, [], [(1, "a")]))) == []
    assert rows_of(lexical.search(*made(spark, [(1, "a")], []))) == []
    assert rows_of(lexical.search(*made(spark, [(1, None), (None, "")], [(1, "a"), (2, None)]))) == []


def test_bounds_are_never_below_scores():
    r = random.Random(2)
    texts = [" ".join(f"t{int(r.paretovariate(0.4)) % 900}" for _ in range(r.choice([0, 3, 50, 2000]))) for _ in range(60)]
    counted = lexical._counted(pa.array(texts, pa.string()))
    block = lexical._block([(i, Counter(lexical.terms_of(texts[r.randrange(60)] + " t1"))) for i in range(20)])
    weight = np.array([r.randrange(0, 9000) for _ in block.terms], np.int64)
    sketches = lexical.Sketches(counted, 25 + counted.n)
    bounds = sketches.bounds(lexical.hashes(pa.array(block.terms, pa.large_binary())), weight, block)
    exact = np.zeros_like(bounds)
    number = {t: i for i, t in enumerate(block.terms)}
    for d, c, impact in zip(counted.doc, counted.code, sketches.impact, strict=True):
        t = number.get(counted.words[int(c)].as_py().encode())
        if t is not None:
            for q in range(20):
                own = slice(block.first[q], block.first[q + 1])
                exact[d, q] += impact * weight[t] * block.times[own][block.term[own] == t].sum()
    assert (bounds >= exact).all() and (bounds == exact).mean() > 0.2


def test_few_documents_are_rescored(monkeypatch):
    """The bounds do their work: most documents are never scored."""
    r = random.Random(4)
    texts = [" ".join(f"t{int(r.paretovariate(0.5)) % 5000}" for _ in range(120)) for _ in range(2_000)]
    counted = lexical._counted(pa.array(texts, pa.string()))
    block = lexical._block([(i, Counter(lexical.terms_of(texts[i])[:40])) for i in range(20)])
    df = Counter(t for text in texts for t in set(lexical.terms_of(text)))
    weight = np.array([math.floor(1000 * math.log(4_002 / (2 * df[t] + 1))) for t in block.terms], np.int64)
    best, seen = lexical._Best(20, 10), []
    add = best.add
    monkeypatch.setattr(best, "add", lambda q, scores, ids: (seen.append(len(ids)), add(q, scores, ids)))
    values = pa.array(block.terms, pa.large_binary())
    lexical._rescored(lexical.Sketches(counted, 25 + counted.n), block, lexical._numbers(counted.words, values), weight, lexical.hashes(values), list(range(2_000)), best)
    assert sum(seen) < 0.2 * 20 * 2_000


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_lexical_search"])
    assert want.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(queries.op12_lexical_search(spark, sf)) == sorted(want.fetchall(), key=str)
