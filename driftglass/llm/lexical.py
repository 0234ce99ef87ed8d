"""Ranked lexical search by hashed max-sketches.

A document's *impact* of a term is the part of its score that only the document decides: (10^9 tf) div (1000 tf + 8 m).
The impacts of all its terms are folded into a sketch: a term's hash names a coordinate, and the coordinate keeps the
largest impact of the terms that fall on it. A sketch has some sixteen coordinates for each distinct term of its
document, so it neither wastes room on short documents nor fills up on long ones. For a query, the sum over its terms
of weight times coordinate is never below the document's score.

Documents stream past a block of queries. For each slice of documents the coordinates of all query terms are looked up
at once, which gives the bounds of all queries. A query's documents are then rescored exactly in descending order of
bound, until the bound is below the score of the last of the best found so far; every document not rescored is out
for certain. Tasks give their best documents of each query, and the best of these are the result.

Two passes read the texts: the first counts documents, terms and, for the terms of the block's queries, the documents
that hold them. Queries come in blocks of at most ``BLOCK_ITEMS`` and ``BLOCK_TERMS`` (any number of blocks); only a
block's terms and their counts are in the driver.

Edge cases: a null text has no terms; a query without terms, and one whose terms no document holds, has no rows; rows
with the same item id are queries of their own, named by it; rows with the same document id are ranked on their own,
ties going to the lower id and those without id last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage
from .hashing import mixed
from .memory import trim

BLOCK_ITEMS, BLOCK_TERMS = 1_000, 100_000
#: Bytes of text that are looked at together, and coordinates looked up at once.
SLICE, CELLS = 1 << 21, 1 << 20
#: A term's letters: ASCII letters and digits, and every character beyond ASCII. The rest becomes space; A-Z lower case.
_TO_TERMS = bytes(ord(chr(b).lower()) if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))
_LAST = 1 << 63  # after every id


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_TERMS).split()


@dataclass(frozen=True)
class Block:
    """Queries with numbers for their distinct terms: query k has the terms ``term[first[k]:first[k + 1]]``."""

    items: list[int | None]
    terms: list[bytes]
    term: np.ndarray
    times: np.ndarray
    first: np.ndarray


def _block(items: list[tuple[int | None, Counter]]) -> Block:
    number: dict[bytes, int] = {}
    term = [number.setdefault(t, len(number)) for _, counts in items for t in counts]
    times = [c for _, counts in items for c in counts.values()]
    first = np.cumsum([0, *(len(counts) for _, counts in items)])
    return Block([i for i, _ in items], list(number), np.array(term, np.int64), np.array(times, np.int64), first)


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The queries that have terms, in blocks; rows reach the driver a partition at a time."""
    held, size = [], 0
    for row in items.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        counts = Counter(terms_of(row[1]))
        if not counts:
            continue
        if held and (len(held) >= BLOCK_ITEMS or size + len(counts) > BLOCK_TERMS):
            yield _block(held)
            held, size = [], 0
        held.append((row[0], counts))
        size += len(counts)
    if held:
        yield _block(held)


@dataclass(frozen=True)
class _Counted:
    """The distinct terms of some documents: rows by document, then by ``code``, a number in ``words``."""

    words: pa.Array
    doc: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    n: np.ndarray  # terms of each document


def _counted(texts: pa.Array) -> _Counted:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    # the same length in bytes, so the offsets hold for the translated texts
    plain = pa.py_buffer(data.to_pybytes().translate(_TO_TERMS)) if data else data
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, plain], offset=texts.offset))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[full.to_numpy(zero_copy_only=False)]
    named = words.filter(full).dictionary_encode()
    code = named.indices.to_numpy().astype(np.int64)
    most = max(1, len(named.dictionary))
    key, tf = np.unique(doc * most + code, return_counts=True)
    return _Counted(named.dictionary, key // most, key % most, tf.astype(np.int64), np.bincount(doc, minlength=len(texts)).astype(np.int64))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, _Counted]]:
    """(ids, counted terms) of a few megabytes of texts at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
        before, at = np.cumsum(sizes) - sizes, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(before, before[at] + SLICE)))
            # a copy, so that a slice's buffer holds its own texts only
            yield batch.column(0).slice(at, stop - at), _counted(pa.concat_arrays([batch.column(1).slice(at, stop - at).cast(pa.large_string()), pa.array([], pa.large_string())]))
            at = stop
            trim()


def _numbers(words: pa.Array, terms: pa.Array) -> np.ndarray:
    """The number of each word among the queries' terms; -1: it is none of them."""
    return pc.fill_null(pc.index_in(words.cast(pa.large_binary()), value_set=terms), -1).to_numpy().astype(np.int64)


def count(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``(term, n)``: the documents that hold each of ``terms``, by number; -1: documents with a term; -2: all terms."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, found, of_terms = pa.array(shared.value, pa.large_binary()), np.zeros(len(shared.value), np.int64), [0, 0]
        for _, counted in _slices(batches):
            number = _numbers(counted.words, values)[counted.code]
            found += np.bincount(number[number >= 0], minlength=len(found))
            of_terms[0] += int((counted.n > 0).sum())
            of_terms[1] += int(counted.n.sum())
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *held.tolist()], pa.int64()), pa.array([*of_terms, *found[held].tolist()], pa.int64())], names=["term", "n"])

    return docs.mapInArrow(rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Sketches:
    """The max-sketches of a slice of documents."""

    def __init__(self, counted: _Counted, m: np.ndarray):
        self.counted, self.m = counted, m
        self.impact = 1_000_000_000 * counted.tf // (1_000 * counted.tf + 8 * m[counted.doc])
        distinct = np.bincount(counted.doc, minlength=len(m))
        width = np.int64(1) << np.ceil(np.log2(np.maximum(16 * distinct, 256))).astype(np.int64)
        self.mask, self.base = (width - 1).astype(np.uint64), np.cumsum(width) - width
        self.cells = np.zeros(int(width.sum()), np.int64)
        np.maximum.at(self.cells, self._at(hashes(counted.words)[counted.code], counted.doc), self.impact)

    def _at(self, hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return self.base[doc] + (hashed & self.mask[doc]).astype(np.int64)

    def bounds(self, hashed: np.ndarray, weight: np.ndarray, block: Block) -> np.ndarray:
        """Upper bounds of the scores: a row for each document, a column for each query."""
        out = np.empty((len(self.m), len(block.items)), np.int64)
        step = max(1, CELLS // max(1, len(block.term)))
        for low in range(0, len(out), step):
            doc = np.arange(low, min(low + step, len(out)))[:, None]
            most = self.cells[self._at(hashed[None, :], doc)] * weight
            out[low : low + step] = np.add.reduceat(most[:, block.term] * block.times, block.first[:-1], axis=1)
        return out


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; clashes only loosen bounds."""
    return mixed(np.array([zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()], np.uint64))


class _Best:
    """The best documents of each query so far, as (-score, id) in order."""

    def __init__(self, queries: int, k: int):
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(queries)]
        self.least, self.k = np.ones(queries, np.int64), k  # scores are above 0

    def add(self, query: int, scores: np.ndarray, ids: list[int]) -> None:
        self.found[query] = sorted([*self.found[query], *((-s, i) for s, i in zip(scores.tolist(), ids, strict=True) if s > 0)])[: self.k]
        if len(self.found[query]) == self.k:
            self.least[query] = -self.found[query][-1][0]


def _rescored(sketches: Sketches, block: Block, number: np.ndarray, weight: np.ndarray, hashed: np.ndarray, ids: list[int], best: _Best) -> None:
    """Rescores the documents of each query in descending order of bound until none can be among the best."""
    counted, bounds = sketches.counted, sketches.bounds(hashed, weight, block)
    used = np.flatnonzero(number[counted.code] >= 0)
    terms = max(1, len(block.terms))
    key, impact = counted.doc[used] * terms + number[counted.code[used]], sketches.impact[used]
    order = np.argsort(key)
    key, impact = np.append(key[order], np.iinfo(np.int64).max), np.append(impact[order], 0)
    for query in np.flatnonzero((bounds >= best.least).any(0)).tolist():
        own = slice(block.first[query], block.first[query + 1])
        term, worth = block.term[own], block.times[own] * weight[block.term[own]]
        bound = bounds[:, query]
        docs = np.flatnonzero(bound >= best.least[query])
        docs = docs[np.argsort(-bound[docs], kind="stable")]
        at, step = 0, best.k
        while at < len(docs) and bound[docs[at]] >= best.least[query]:
            part = docs[at : at + step]
            wanted = part[:, None] * terms + term
            place = np.searchsorted(key, wanted)
            best.add(query, (np.where(key[place] == wanted, impact[place], 0) * worth).sum(1), [ids[d] for d in part.tolist()])
            at, step = at + step, 2 * step


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``k`` best documents with a score above 0."""
    spark = docs.sparkSession
    stage, rows_ = Stage(spark, "search"), docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b, block in enumerate(blocks_of(items, item_col, item_text_col)):
        found = stage.save(_searched(rows_, block, k), f"block-{b}")
        result = found if b == 0 else result.union(found)
    return result


def _searched(docs: DataFrame, block: Block, k: int) -> DataFrame:
    spark = docs.sparkSession
    counts = {r.term: r.n for r in count(docs, block.terms).collect()}
    with_terms, all_terms = counts.get(-1, 0), counts.get(-2, 0)
    weight = np.zeros(len(block.terms), np.int64)
    for term, df in counts.items():
        if term >= 0:
            weight[term] = int(np.floor(1000 * np.log((2 * with_terms + 2) / (2 * df + 1))))
    shared = spark.sparkContext.broadcast((block, weight))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight = shared.value
        values, best = pa.array(block.terms, pa.large_binary()), _Best(len(block.items), k)
        hashed = hashes(values)
        for ids, counted in _slices(batches):
            m = 25 + 75 * counted.n * with_terms // max(1, all_terms)
            _rescored(Sketches(counted, m), block, _numbers(counted.words, values), weight, hashed, [_LAST if i is None else i for i in ids.to_pylist()], best)
        out = [(q, None if i == _LAST else i, -s) for q, found in enumerate(best.found) for s, i in found]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score"])

    best = docs.mapInArrow(rows, "query long, doc_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, i) for q, i in enumerate(block.items)], "query long, item_id long")
    return ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
