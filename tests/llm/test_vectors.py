from __future__ import annotations

from collections import defaultdict

import numpy as np

from driftglass.llm import hnsw


def data():
    rng = np.random.default_rng(5)
    rows = []
    centers = rng.normal(size=(25, 16))
    for c in centers:
        for _ in range(rng.integers(1, 30)):
            rows.append((c + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist())
    rows += [rng.normal(size=16).astype(np.float32).tolist() for _ in range(150)]
    rows += [rows[3]] * 60 + [[0.0] * 16, None, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None, *[1.0] * 15], [], [1.0, 2.0], [2.0, 4.0], (np.array(rows[7]) * 2).astype(np.float32).tolist()]
    return [(i, v, i % 3) for i, v in enumerate(rows)]


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    rows = data()
    want, links = brute(rows, 0.9)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int").repartition(4)
    for beam in (48, 2):
        monkeypatch.setattr(hnsw, "QUERY_BEAM", beam)
        monkeypatch.setattr(hnsw, "SHARDS", 3)
        monkeypatch.setattr(hnsw, "QUERY_ROWS", 300)
        monkeypatch.setattr(hnsw, "BATCH", 100)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_duplicates(vectors).collect()}
        assert len(got) == len(rows)
        assert all(got[i][0] == links[i] and got[i][1] == want[i] for i in got)
        assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def brute(rows, least):
    sound = [(i, np.array(v, float)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i, *_ in rows}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sound):
        for j, b in sound[:k]:
            if len(a) == len(b) and a @ b >= least * np.linalg.norm(a) * np.linalg.norm(b):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in root}, links


def test_graph_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 24))
    x[300:600] = x[:300] + rng.normal(size=(300, 24)) * 0.1
    x = hnsw._unit(x).astype(np.float32)
    graph = hnsw.Graph.build(x)
    assert len(graph.layers) > 1 and all((layer < len(layer)).all() for layer in graph.layers)
    a, b, near, first, got = graph.audited(x[:200], 0.8, 16)
    assert near == got >= first
    assert set(zip(a.tolist(), b.tolist(), strict=True)) >= set(zip(*np.nonzero(x[:200] @ x.T >= 0.8), strict=True)) and len(a) == (x[:200] @ x.T >= 0.8).sum()


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(5, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, hnsw.near_duplicates(one).collect()), key=str) == sorted([(5, 1, 5, True), (None, 1, 5, False), (None, 0, None, False)], key=str)


def test_double_precision(spark):
    """Vectors keep their type: pairs at the limit, and lengths that single precision cannot hold."""
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.19**0.5]), (2, [1e-200, 0.0]), (3, [1e200, 1e190]), (4, [0.0, -1e-300]), (5, [0.0, -7.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_duplicates(vectors).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (1, 4), 5: (1, 4)}
