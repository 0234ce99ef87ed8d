"""Runs of repeated words by Lyndon roots.

A run is a stretch of words with smallest period q that cannot be extended with this period. Every run has an order of
the words - a given one or its reverse - in which the Lyndon words of length q inside it, its roots, are the longest
Lyndon words that start at their places. So the longest Lyndon words from all places, under both orders, name all
periods and places to look at.

Lyndon arrays come from the first phase of Baier's suffix sorter. Suffixes start in groups by first word; groups are
taken from the highest down, and each suffix of a group is attached to the nearest suffix before it whose group is
lower. Suffixes that got equally many attachments from this group leave their own group together, for a new one right
above it. When all groups are done, the words that a suffix has drawn to itself are its longest Lyndon prefix.

Roots are extended by longest common extensions (blocks of words compared at doubling lengths) to the left and right; a
root inside a run already found is not extended again.

Before that, stretches that can hold no run are put aside: in a run of exponent e each word occurs at least floor(e)
times, so words that occur less often in a stretch cut it, again and again until nothing changes (or a number of rounds
is over: it only saves work).

Edge cases: a null or blank text has no words and no runs, and collapses to an empty text; rows with null or repeated
ids are kept, each on its own; an empty table gives no rows; other columns of the input are ignored. Rows stay in their
partitions. Memory holds a slice of some megabytes, or one text if that is longer, in a few integers a word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import trim

#: Words that are looked at together.
SLICE = 1 << 18
ROUNDS = 12
SCHEMA = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon_lengths(values: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word from each place of a sequence of integers."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    starts = np.flatnonzero(np.concatenate((np.ones(1, bool), ranked[1:] != ranked[:-1])))
    first = np.repeat(starts, np.diff(np.append(starts, n)))  # the group of a slot, named by its first slot
    suffix, slot, group, top = order.tolist(), np.argsort(order).tolist(), first[np.argsort(order)].tolist(), [0] * n
    for low, high in zip(starts.tolist(), [*(starts[1:] - 1).tolist(), n - 1], strict=True):
        top[low] = high
    length, before = [1] * n, [-1] * n
    high = n - 1
    while high >= 0:
        low = group[suffix[high]]
        own = length[suffix[high]]
        targets = []
        for i in sorted(suffix[low : high + 1]):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                targets.append(p)
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in Counter(targets).items():
            moved.setdefault((times, group[p]), []).append(p)
        for times, old in sorted(moved, reverse=True):  # those with most attachments end highest
            members = moved[times, old]
            end = top[old]
            fresh = end - len(members) + 1
            at = end
            for p in members:  # to the last slots of their group
                here, other = slot[p], suffix[at]
                suffix[here], slot[other] = other, here
                suffix[at], slot[p] = p, at
                group[p] = fresh
                length[p] += times * own
                at -= 1
            top[old] = fresh - 1
            top[fresh] = end
        high = low - 1
    return np.array(length, np.int64)


def _same(values: np.ndarray, a: int, b: int, step: int, most: int) -> int:
    """How many values from a and from b on agree, going by ``step`` (1 or -1), at most ``most``."""
    done, block = 0, 16
    while done < most:
        block = min(block, most - done)
        if step > 0:
            differ = values[a + done : a + done + block] != values[b + done : b + done + block]
        else:
            differ = values[a - done - block + 1 : a - done + 1][::-1] != values[b - done - block + 1 : b - done + 1][::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, block = done + block, 2 * block
    return done


def runs_of(values: np.ndarray, exponent: int, shortest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of integers, by start and period, that is at least
    ``shortest`` long and ``exponent`` (2 or more) times its period."""
    n, found = len(values), set()
    for sign in (1, -1):
        lengths = lyndon_lengths(sign * values)
        place = np.arange(n)
        likely = np.ones(n, bool)
        # a run holds at least exponent - 1 whole roots in a row
        for k in range(1, exponent - 1):
            there = np.minimum(place + k * lengths, n - 1)
            likely &= (place + (k + 1) * lengths <= n) & (lengths[there] == lengths) & (values[there] == values)
        reached: dict[int, int] = {}
        for i in np.flatnonzero(likely).tolist():
            q = int(lengths[i])
            if i + q <= reached.get(q, 0):  # inside the last run of this period
                continue
            right = _same(values, i, i + q, 1, n - i - q)
            left = _same(values, i - 1, i + q - 1, -1, i)
            start, stop = i - left, i + q + right
            if stop - start >= 2 * q:
                reached[q] = stop
                if stop - start >= max(shortest, exponent * q):
                    found.add((start, stop - start, q))
    return sorted((s, length, q) for s, length, q in found)


def _stretches(codes: np.ndarray, text: np.ndarray, least: int, shortest: int) -> list[np.ndarray]:
    """Places of each stretch that may hold a run, of texts in a row; ``least``: occurrences of each of a run's words."""
    place, stretch = np.arange(len(codes)), text
    words = int(codes.max()) + 1 if len(codes) else 0
    for _ in range(ROUNDS):
        if not len(place):
            break
        _, name, count = np.unique(stretch * words + codes, return_inverse=True, return_counts=True)
        kept = count[name] >= least
        if kept.all():
            break
        place, codes, stretch = place[kept], codes[kept], stretch[kept]
        stretch = np.cumsum((np.diff(place, prepend=-2) > 1) | (np.diff(stretch, prepend=-1) != 0))
        long = np.bincount(stretch)[stretch] >= shortest
        place, codes, stretch = place[long], codes[long], stretch[long]
    return np.split(place, np.flatnonzero(np.diff(stretch)) + 1) if len(place) else []


def find_in(texts: list[list[bytes]], exponent: int, shortest: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each of some texts, given as words."""
    size = np.array([len(words) for words in texts], np.int64)
    flat = pa.array([w for words in texts for w in words], pa.binary()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first, text = np.cumsum(size) - size, np.repeat(np.arange(len(texts)), size)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for places in _stretches(codes, text, exponent, shortest):
        k, low = int(text[places[0]]), int(places[0])
        found[k] += [(start + low - int(first[k]), length, q) for start, length, q in runs_of(codes[places], exponent, shortest)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that lie in a run after its first period, joined by single spaces."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, q in runs:
        kept[start + q : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def find_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``runs`` (by start, then period) and the ``collapsed`` text of each text.

    Words are what ASCII white space parts. A run is at least ``shortest`` words long and ``exponent`` times its period.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            held, words, low = [], 0, 0
            texts = batch.column(1).cast(pa.large_binary())
            for k in range(len(texts)):
                held.append((texts[k].as_py() or b"").split())
                words += len(held[-1])
                if words >= SLICE or k == len(texts) - 1:
                    runs = find_in(held, exponent, shortest)
                    columns = [
                        batch.column(0).slice(low, len(held)),
                        pa.array(list(map(len, held)), pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs], pa.list_(_RUN)),
                        pa.array([collapsed(w, r) for w, r in zip(held, runs, strict=True)], pa.binary()).cast(pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])
                    held, words, low = [], 0, k + 1
            trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(rows, SCHEMA)
