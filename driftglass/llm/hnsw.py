"""Embedding near-duplicates with a navigable small-world graph per shard.

Equal vectors are one node with a count. Nodes are dealt by hash into shards of bounded size; each shard's task builds
a hierarchical graph and writes it as rows. Every node is then asked of every shard: a task reads a shard's graph once
and the nodes stream past it. A query whose beam is full of matches is asked again with a beam twice as wide, and of
each batch some queries are audited against all vectors of the shard, widening all beams until the audit finds nothing
missed; what the first beams missed is counted and written. Matches are verified by cosine in double precision; a batch
returns counts, and links as a spanning forest, so a family of near copies is never written out pair by pair.

Asking every shard costs nodes times shards by its nature; graphs are copied once for each ``QUERY_ROWS`` nodes.

Edge cases: vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of
other dimensions never meet; lengths near the limits of double precision are scaled first; repeated ids are rows of
their own, and null ids take part but name no component (it is null only where no member has an id); an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, connected_components

LINKS = 16
BUILD_BEAM = 48
QUERY_BEAM = 48
EXPANDED = 6
CHUNK = 256
AUDITED = 48
#: The least number of shards, and the components of all vectors of one: 200,000 vectors of 64.
SHARDS = 12
SHARD_VALUES = 12_800_000
#: Nodes that one task asks of a shard.
QUERY_ROWS = 1 << 18
#: Nodes asked at once.
BATCH = 8_192
#: float32 dot products of unit vectors are this close to the cosine
SLACK = 1e-4


def _diverse(x: np.ndarray, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each row its neighbours: candidates, best first, nearer to the row than to any neighbour taken before; then
    the best of the others. -1 stands for none."""
    order = np.argsort(-sims, axis=1, kind="stable")
    found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
    there = found >= 0
    v = x[np.where(there, found, 0)]
    between = v @ v.transpose(0, 2, 1)
    taken = np.zeros(found.shape, bool)
    for j in range(found.shape[1]):
        nearest = np.where(taken, between[:, j, :], -2).max(1)
        taken[:, j] = there[:, j] & (sims[:, j] > nearest) & (taken.sum(1) < most)
    rank = np.where(taken, 0, np.where(there, 1, 2)) * found.shape[1] + np.arange(found.shape[1])
    best = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(found, best, 1)


def _search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, similarities) of each query's beam, best first; -1 and -2 where it is not full."""
    n, rows = len(links), np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    seen[rows, np.where(entry < 0, n, entry)] = True
    at = entry.copy()
    sim = np.where(at >= 0, np.einsum("qkd,qd->qk", x[np.maximum(at, 0)], q), np.float32(-2))
    open_ = at >= 0
    width = min(EXPANDED, beam)
    while True:
        if at.shape[1] > beam:
            best = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
            at, sim, open_ = (np.take_along_axis(a, best, 1) for a in (at, sim, open_))
        active = np.flatnonzero(open_.any(1))
        if not len(active):
            break
        score = np.where(open_[active], sim[active], -3)
        k = min(width, score.shape[1])
        pick = np.argpartition(-score, k - 1, axis=1)[:, :k]
        chosen = np.take_along_axis(open_[active], pick, 1)
        open_[active[:, None], pick] = False
        near = np.where(chosen[:, :, None], links[np.maximum(at[active[:, None], pick], 0)], -1).reshape(len(active), -1)
        near = np.where(near < 0, n, near)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[active[:, None], near]] = n
        seen[active[:, None], near] = True
        new = near < n
        s = np.where(new, np.matmul(x[np.where(new, near, 0)], q[active][:, :, None])[:, :, 0], np.float32(-2))
        more = lambda a, part, none: np.concatenate((a, _spread(part, active, len(q), none)), 1)
        at, sim, open_ = more(at, np.where(new, near, -1), -1), more(sim, s, -2), more(open_, new, False)
    order = np.argsort(-sim, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(sim, order, 1)


def _spread(part: np.ndarray, rows: np.ndarray, n: int, none) -> np.ndarray:
    out = np.full((n, part.shape[1]), none, part.dtype)
    out[rows] = part
    return out


class Graph:
    """Vectors ordered by falling level, so that layer l is a prefix; ``layers[l]`` holds the neighbours of its nodes."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        """x: unit vectors, ordered by falling level."""
        sizes = [len(x)]
        while sizes[-1] > 4 * LINKS:
            sizes.append(max(1, sizes[-1] // LINKS))
        graph = cls(x, [np.full((n, 2 * LINKS if i == 0 else LINKS), -1, np.int32) for i, n in enumerate(sizes)])
        for layer in range(len(sizes) - 1, -1, -1):
            done = 0
            while done < sizes[layer]:
                step = min(CHUNK, max(done, 4 * LINKS), sizes[layer] - done)
                graph._insert(layer, done, done + step)
                done += step
        return graph

    def _entries(self, q: np.ndarray, down_to: int) -> np.ndarray:
        """Places in layer ``down_to`` near each query, from the layers above it."""
        if down_to == len(self.layers) - 1:
            return np.zeros((len(q), 1), np.int64)
        top = len(self.layers[-1])
        at = np.argsort(-(q @ self.x[:top].T), axis=1)[:, :4]
        for layer in range(len(self.layers) - 2, down_to, -1):
            at = _search(self.x, self.layers[layer], q, at, 8)[0][:, :4]
        return at

    def _insert(self, layer: int, lo: int, hi: int) -> None:
        links, q = self.layers[layer], self.x[lo:hi]
        own = q @ q.T
        np.fill_diagonal(own, -2)
        k = min(hi - lo, 2 * LINKS)
        best = np.argpartition(-own, k - 1, axis=1)[:, :k]
        found, sims = best + lo, np.take_along_axis(own, best, 1)
        if lo:
            entry = self._entries(q, layer)
            at, sim = _search(self.x, links[:lo], q, np.where(entry < lo, entry, -1) if (entry < lo).any(1).all() else np.zeros((len(q), 1), np.int64), BUILD_BEAM)
            found, sims = np.concatenate((found, at[:, :BUILD_BEAM]), 1), np.concatenate((sims, sim[:, :BUILD_BEAM]), 1)
        found = np.where(sims > -1.5, found, -1)
        chosen = _diverse(self.x, found, sims, LINKS)
        links[lo:hi, : chosen.shape[1]] = chosen
        # the other way
        u, v = np.repeat(np.arange(lo, hi), chosen.shape[1]), chosen.ravel()
        u, v = u[v >= 0], v[v >= 0]
        if not len(v):
            return
        sim = np.einsum("ed,ed->e", self.x[u], self.x[v])
        order = np.lexsort((-sim, v))
        u, v, sim = u[order], v[order], sim[order]
        nodes, first, count = np.unique(v, return_index=True, return_counts=True)
        rank = np.arange(len(v)) - np.repeat(first, count)
        most = links.shape[1]
        fits = rank < most
        more = np.full((len(nodes), most), -1, np.int64)
        more[np.repeat(np.arange(len(nodes)), count)[fits], rank[fits]] = u[fits]
        for at in range(0, len(nodes), CHUNK):
            part = nodes[at : at + CHUNK]
            both = np.sort(np.concatenate((links[part], more[at : at + CHUNK]), 1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.where(both >= 0, np.einsum("nkd,nd->nk", self.x[np.maximum(both, 0)], self.x[part]), -2)
            links[part] = _diverse(self.x, both, s, most)

    def within(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place) of at least this similarity; beams full of matches are doubled."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(np.arange(i, min(i + CHUNK, len(q))), beam) for i in range(0, len(q), CHUNK)]
        while todo:
            rows, width = todo.pop()
            width = min(width, len(self.x))
            at, sim = _search(self.x, self.layers[0], q[rows], self._entries(q[rows], 0), width)
            hit = (sim >= least) & (at >= 0)
            full = hit[:, :width].all(1) & (hit.sum(1) >= width) & (width < len(self.x))
            r, c = np.nonzero(hit & ~full[:, None])
            found.append((rows[r], at[r, c]))
            if full.any():
                wider = rows[full]
                todo += [(wider[i : i + 64], width * 2) for i in range(0, len(wider), 64)]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def audited(self, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, int, int, int]:
        """``within``, with beams widened until a sample of the queries, asked of every vector, has missed nothing; then
        the matches of the sample, those that the first beams found, and those that the last ones found."""
        sample = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int))
        near, first = sum(int(np.count_nonzero(self.x @ q[i] >= least)) for i in sample), None
        while True:
            got = len(self.within(q[sample], least, beam)[0])
            first = got if first is None else first
            if got == near or beam >= len(self.x):
                break
            beam *= 2
        return *self.within(q, least, beam), near, first, got


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors in double precision; those whose squares might leave its range are scaled."""
    x = column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)
    most = np.abs(x).max(axis=1, keepdims=True)
    return x / np.where((most > 1e-100) & (most < 1e100), 1.0, most)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _build(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("order").drop_columns(["order"]).combine_chunks()
    graph = Graph.build(_unit(_matrix(rows["embedding"].combine_chunks())).astype(np.float32))
    links = [[layer[i].tolist() for layer in graph.layers if i < len(layer)] for i in range(len(rows))]
    return rows.append_column("place", pa.array(np.arange(len(rows)), pa.int32())).append_column("links", pa.array(links, pa.list_(pa.list_(pa.int32()))))


class _Shard:
    """A shard's graph from its rows, which come ordered by place; vectors as they are given."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.raw, links = rows["embedding"].combine_chunks(), rows["links"].combine_chunks()
        self.node, self.copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        depth = np.diff(links.offsets.to_numpy())
        inner = links.flatten()
        width, start = np.diff(inner.offsets.to_numpy()), np.cumsum(depth) - depth
        flat, begin = inner.flatten().to_numpy(), inner.offsets.to_numpy() - inner.offsets[0].as_py()
        layers = []
        for layer in range(depth.max()):
            first = start[: int((depth > layer).sum())] + layer
            layers.append(flat[begin[first][:, None] + np.arange(width[first[0]])])
        x = np.concatenate([_unit(_matrix(self.raw.slice(i, BATCH))).astype(np.float32) for i in range(0, len(rows), BATCH)])
        self.graph = Graph(x, layers)

    def ask(self, node: np.ndarray, vectors: pa.Array, least: float) -> pa.RecordBatch:
        q = _matrix(vectors)
        a, b, near, first, got = self.graph.audited(_unit(q).astype(np.float32), least - SLACK, QUERY_BEAM)
        other = node[a] != self.node[b]
        a, b = a[other], b[other]
        sure = [np.zeros(0, bool)]
        for i in range(0, len(a), 65536):
            x, y = q[a[i : i + 65536]], _matrix(self.raw.take(pa.array(b[i : i + 65536])))
            sure.append(np.einsum("ed,ed->e", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= least)
        sure = np.concatenate(sure)
        a, b = a[sure], b[sure]
        counts = np.bincount(a, self.copies[b], len(q)).astype(np.int64)
        some = np.flatnonzero(counts)
        low, high = _forest(node[a], self.node[b])
        kind = np.repeat([LINKS_OF, JOINED, AUDIT], [len(some), len(low), 3])
        return pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(np.concatenate((node[some], low, [0, 1, 2]))), pa.array(np.concatenate((counts[some], high, [near, first, got])))],
            names=["kind", "a", "b"],
        )


#: What a row (kind, a, b) of an answer tells: node a has b links; a and b are linked; audit number a counts b.
LINKS_OF, JOINED, AUDIT = 0, 1, 2


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least node of its component among the pairs."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lower = label.copy()
        np.minimum.at(lower, u, label[v])
        np.minimum.at(lower, v, label[u])
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _answers(least: float):
    """Answers of each shard to its queries. Rows come by (dim, shard, split), a graph's rows before the queries."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, shard = [], None, None
        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("dim", "shard", "split", "asks")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                part, (*key, asks) = batch.slice(low, high - low), keys[low].tolist()
                if not asks:
                    held, at, shard = (held if at == key else []) + [part], key, None
                elif at == key:
                    if shard is None:
                        shard, held = _Shard(held), []
                    for i in range(0, high - low, BATCH):
                        piece = part.slice(i, BATCH)
                        yield shard.ask(piece.column("node").to_numpy(), piece.column("embedding"), least)

    return answers


def _sound(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per input row: id, n_links (other vectors linked directly), component_id (smallest id reachable) and kept.

    The audits' counts stay in the stage's table ``answers``; their recall after widening must be 0.9 or more.
    """
    stage = Stage(vectors.sparkSession, "hnsw")
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("embedding"))
    classes = rows.where(_sound(F.col("embedding"))).groupBy("embedding").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = stage.save(classes.select(F.monotonically_increasing_id().alias("node"), "least", "copies", F.size("embedding").alias("dim"), "embedding"), "classes")
    total, widest = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shards, splits = max(SHARDS, -(-total * widest // SHARD_VALUES)), max(1, -(-total // QUERY_ROWS))
    shard = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard")
    nodes = classes.select("dim", shard, "node", "copies", "embedding")
    order = F.xxhash64("node", F.lit("level"))  # who is in the upper layers
    graphs = stage.save(nodes.withColumn("order", order).groupBy("dim", "shard").applyInArrow(_build, f"dim int, shard int, node long, copies long, embedding {kind}, place int, links array<array<int>>"), "graphs")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = graphs.select("dim", "shard", every(splits).alias("split"), F.lit(0).alias("asks"), "place", "node", "copies", "embedding", "links")
    asked = nodes.select("dim", F.pmod(F.xxhash64("node", F.lit("split")), F.lit(splits)).cast("int").alias("split"), "node", "embedding")
    asked = asked.select("dim", every(shards).alias("shard"), "split", F.lit(1).alias("asks"), F.lit(None).cast("int").alias("place"), "node", F.lit(None).cast("long").alias("copies"), "embedding", F.lit(None).cast("array<array<int>>").alias("links"))
    met = held.union(asked).repartition(shards * splits, "dim", "shard", "split").sortWithinPartitions("dim", "shard", "split", "asks", "place")
    answers = stage.save(met.mapInArrow(_answers(least), "kind int, a long, b long"), "answers")
    audit = {r.a: r.n for r in answers.where(F.col("kind") == AUDIT).groupBy("a").agg(F.sum("b").alias("n")).collect()}
    near, first, got = (audit.get(k, 0) for k in range(3))
    logging.getLogger(__name__).info("audited matches %d, found by first beams %d, by last beams %d", near, first, got)
    if got < 0.9 * near:
        raise RuntimeError(f"recall of the audits is {got} of {near}")
    roots = connected_components(answers.where(F.col("kind") == JOINED).select("a", "b"), stage)
    counts = answers.where(F.col("kind") == LINKS_OF).groupBy("a").agg(F.sum("b").alias("links"))
    known = classes.join(counts, F.col("node") == F.col("a"), "left").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    known = known.select("embedding", "least", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    found = stage.save(known.join(names, "root").select("embedding", "n_links", "component_id"), "found")
    # a vector that links with nothing has no class
    linked = rows.join(found.withColumn("_found", F.lit(True)), "embedding", "left")
    component = F.when(F.col("_found"), F.col("component_id")).otherwise(F.col("id"))
    return linked.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
