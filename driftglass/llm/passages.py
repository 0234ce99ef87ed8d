"""Repeated passages by prefix-free parsing.

Texts are read as UTF-8 bytes. A rolling hash of ``GRAM`` bytes sets a trigger wherever it is the least of some
``spread`` neighbouring hashes, so triggers depend on nearby bytes alone and every string of ``length`` bytes holds
its own first and last one. The bytes between these two are the string's *spine*: the phrases of the parse that lie
wholly inside it. Equal strings have equal spines, at the same place.

Parse. For every spine of every text one row goes to Spark: the spine's hash, the hash of the spine with the widest
margins a string around it can have, and the run of string starts it stands for. Sorting the rows by these two hashes
brings equal phrase sequences together (only equality over ``length`` bytes is asked, so the suffix order of parse and
dictionary is kept up to that depth and up to a renaming of phrases by their hashes). A spine seen once ends here; one
seen with the same margins elsewhere marks its whole run.

Dictionary. What is left are strings that end inside a phrase next to a difference. For these the single strings are
hashed, one representative for each distinct margin, and the sorted strings that occur twice are marked.

Rows that repeat within a task are folded there, so a passage in a third of all texts gives a sort group with a few
rows from each task. Texts count once for each row; a text equal to another is found by its own rows like any passage.

Edge cases: null is the empty text; texts below ``length`` bytes lose nothing; rows are told apart by content only, so
repeated rows, null ids and clashing column names do no harm; an empty table gives no rows; texts of any length are
read in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stage, free_names, text_key
from .hashing import Hasher, mixed
from .memory import trim

GRAM = 16
#: Bytes handled at once in a task: some twenty arrays of eight times this size.
PIECE = 1 << 20
#: Rows after which a task folds and hands on what it has found.
FOLD = 1 << 20
#: Parts that the rows of one text are dealt to when they meet its spans.
PARTS = 8


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value in each window of ``width``; the first one of equals. Doubling, then two windows meet."""
    at = np.arange(len(values), dtype=np.int32)
    done = 1
    while done * 2 <= width:
        left, right = at[:-done], at[done:]
        at = np.where(values[right] < values[left], right, left)
        done *= 2
    if done < width:
        left, right = at[: len(at) - (width - done)], at[width - done :]
        at = np.where(values[right] < values[left], right, left)
    return at


class Parser:
    """Spines and string hashes of a buffer that holds many texts one after the other."""

    def __init__(self, length: int):
        self.length, self.spread = length, (length - GRAM) * 5 // 12
        self.margin = 2 * self.spread + length + GRAM + 1
        self.most = PIECE + 2 * self.margin + 16
        self.a, self.b = Hasher(self.most, 1), Hasher(self.most, 2)

    def spines(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, more: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Rows (spine, margins, owner, first start, starts) of the runs that begin within the starts [lo, hi) of each
        text; a run may go on up to more[i]. Text i is data[begin[i]:end[i]]; positions are the buffer's."""
        sums, sums2 = self.a.sums(data), self.b.sums(data)
        n = len(data)
        grams = self.a.of(sums, at := np.arange(n - GRAM + 1), at + GRAM)
        least = _first_least(grams, self.spread)
        far = self.length - GRAM - self.spread + 1
        # one start before lo tells whether the run at lo began in the piece before
        early = np.where(lo > begin, lo - 1, lo)
        sizes = more - early
        owner = np.repeat(np.arange(len(lo)), sizes)
        p = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + early[owner]
        x, y = least[p], least[p + far]
        new = np.ones(len(p), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(p)))
        own = (p[first] >= lo[owner[first]]) & (p[first] < hi[owner[first]])
        first, count = first[own], count[own]
        x, y, owner = x[first].astype(np.int64), y[first].astype(np.int64), owner[first]
        left, right = np.maximum(x - self.spread + 1, begin[owner]), np.minimum(y + GRAM + self.spread - 1, end[owner])
        spine = self.a.of(sums, x, y + GRAM)
        # what the text's ends cut off must agree as well
        cut = (x - left).astype(np.uint64) << np.uint64(32) | (right - y).astype(np.uint64)
        margins = self.b.of(sums2, left, right) ^ mixed(cut)
        return spine, margins, owner, p[first], count

    def strings(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.b.of(self.b.sums(data), starts, starts + self.length)


def _buffers(text: pa.Array, parser: Parser) -> Iterator[tuple]:
    """The texts of a batch as buffers of about PIECE bytes: data, rows, offset of each in its text, and what
    Parser.spines takes. A text larger than a piece is cut, each piece with the bytes its runs and margins reach."""
    text = text.cast(pa.large_binary())
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    bounds = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    parts, held = [], 0
    for i in range(len(text)):
        s, e = int(bounds[i]), int(bounds[i + 1])
        starts = max(e - s - parser.length + 1, 0)
        for lo in range(0, starts, PIECE):
            hi = min(lo + PIECE, starts)
            a, b = max(0, lo - parser.margin), min(e - s, hi + parser.margin)
            if held + b - a > parser.most - parser.margin and parts:
                yield _joined(raw, parts, parser)
                parts, held = [], 0
            parts.append((i, s + a, s + b, lo - a, hi - a, min(hi + parser.spread, starts) - a, a))
            held += b - a
    if parts:
        yield _joined(raw, parts, parser)


def _joined(raw: np.ndarray, parts: list, parser: Parser):
    data = np.concatenate([raw[a:b] for _, a, b, *_ in parts] + [np.zeros(GRAM, np.uint8)])
    sizes = np.array([b - a for _, a, b, *_ in parts])
    begin = np.cumsum(sizes) - sizes
    at = lambda k: np.array([p[k] for p in parts])
    # inside a long text a piece's ends are no ends: margins never reach them
    return data, at(0), at(6), (begin + at(3), begin + at(4), begin + at(5), begin, begin + sizes)


def _folded(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, told, seen): for each distinct (s, g) one row is kept; told are the others, a text's own repeats of a row
    (copies of the text) once; seen is 2 where the task has (s, g) more than once."""
    order = np.lexsort((rows["start"], rows["th"], rows["g"], rows["s"]))
    s, g, th, start = (rows[k][order] for k in ("s", "g", "th", "start"))
    new, same = np.ones(len(s), bool), np.zeros(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
    same[1:] = ~new[1:] & (th[1:] == th[:-1]) & (start[1:] == start[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(s)))
    seen = np.empty(len(s), np.int64)
    seen[order] = np.repeat(np.minimum(count, 2), count)
    return order[new], order[~new & ~same], seen


KEYED = "s long, g long, th long, run long"
#: ``run``: first start, then 16 bits of starts, 2 bits of "seen in the task" and 1 bit "only hands on a mark".
_START, _COUNT, _SEEN = 19, 3, 1


def _emit(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    kept, told, seen = _folded(rows)
    run = rows["start"].astype(np.int64) << _START | rows["count"] << _COUNT | seen << _SEEN
    # the kept row speaks for all; others that repeat here are marked at once and need no company
    yield _batch(rows["s"][kept], rows["g"][kept], rows["th"][kept], run[kept])
    if len(told):
        own = mixed(rows["th"][told].view(np.uint64) + rows["start"][told].astype(np.uint64))
        yield _batch(own, own, rows["th"][told], run[told] | 1)


def _batch(s, g, th, run) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (s, g, th, run)], names=["s", "g", "th", "run"])


def _gathered(found: Iterator[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for rows in found:
        held.append(rows)
        size += len(rows["s"])
        if size >= FOLD:
            yield from _emit({k: np.concatenate([r[k] for r in held]) for k in held[0]})
            held, size = [], 0
    if size:
        yield from _emit({k: np.concatenate([r[k] for r in held]) for k in held[0]})
    held.clear()
    trim()


def _spine_rows(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length)

        def found():
            for batch in batches:
                th = batch.column("th").to_numpy()
                for data, row, offset, places in _buffers(batch.column("text"), parser):
                    spine, margins, owner, start, count = parser.spines(data, *places)
                    yield {"s": spine, "g": margins, "th": th[row[owner]], "start": start - places[3][owner] + offset[owner], "count": count}

        yield from _gathered(found())

    return parse


def _resolved(keyed: DataFrame) -> DataFrame:
    """The keyed rows with ``n_s`` and ``n_g``, how often (at most twice from a task) s and (s, g) occur."""
    n = F.shiftright("run", _SEEN).bitwiseAND(3)
    by_s, by_g = Window.partitionBy("s"), Window.partitionBy("s", "g")
    placed = keyed.repartition("s").sortWithinPartitions("s", "g", "run")
    counted = placed.withColumn("n_g", F.sum(n).over(by_g)).withColumn("pick", F.row_number().over(by_g.orderBy("run")))
    return counted.withColumn("n_s", F.sum(n).over(by_s)).withColumn("alone", F.min("n_g").over(by_s) == 1)


def _marks(resolved: DataFrame) -> DataFrame:
    """Runs (th, start, count) of starts whose string occurs elsewhere; open: still to be judged by single strings."""
    start, count = F.shiftright("run", _START), F.shiftright("run", _COUNT).bitwiseAND(0xFFFF)
    told, sure = F.col("run").bitwiseAND(1) == 1, F.col("n_g") >= 2
    open_ = (F.col("n_s") >= 2) & ~told & F.col("alone") & (~sure | (F.col("pick") == 1))
    return resolved.where(told | (F.col("n_s") >= 2)).select("th", start.alias("start"), count.cast("int").alias("count"), (told | sure).alias("sure"), F.when(open_, F.col("s")).alias("spine")).where("sure or spine is not null")


def _string_rows(length: int):
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Parser(length).b

        def found():
            for batch in batches:
                text = batch.column("text").cast(pa.large_binary())
                for i, (th, runs) in enumerate(zip(batch.column("th").to_pylist(), batch.column("runs"), strict=True)):
                    spine = runs.values.field("spine")
                    open_ = spine.is_valid().to_numpy(zero_copy_only=False)
                    if not open_.any():
                        continue
                    raw = np.frombuffer(text[i].as_buffer(), np.uint8)
                    start, count = (runs.values.field(k).to_numpy()[open_].astype(np.int64) for k in ("start", "count"))
                    s = spine.drop_null().to_numpy().view(np.uint64)
                    order = np.argsort(start, kind="stable")
                    start, count, s = start[order], count[order], s[order]
                    a = 0
                    while a < len(start):  # runs that lie within one piece of the text
                        b = max(a + 1, int(np.searchsorted(start + count, start[a] + PIECE, "right")))
                        p = np.repeat(start[a:b] - np.concatenate(([0], np.cumsum(count[a:b])[:-1])), count[a:b]) + np.arange(count[a:b].sum())
                        low = int(start[a])
                        data = raw[low : int((start[a:b] + count[a:b]).max()) + length]
                        h = hasher.of(hasher.sums(data), p - low, p - low + length)
                        yield {"s": mixed(np.repeat(s[a:b], count[a:b]) ^ h), "g": h, "th": np.full(len(p), th, np.int64), "start": p, "count": np.ones(len(p), np.int64)}
                        a = b

        yield from _gathered(found())

    return strings


def covered(start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [from, to) covered by the strings that begin in the given runs of starts."""
    order = np.argsort(start, kind="stable")
    a, b = start[order], np.maximum.accumulate((start + count - 1 + length)[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:] - 1, len(b) - 1)] if len(b) else b


def _judged(docs: DataFrame, stage: Stage, key: Column, text_col: str, length: int) -> tuple[DataFrame, DataFrame]:
    """``(th, text, runs)`` of each distinct text with marked runs, stored as "held", and ``(th, starts)`` of the single
    strings found; "marks" is read no more."""
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"), key.alias("th"))
    long_ = texts.where(F.octet_length("text") >= length)
    keyed = long_.mapInArrow(_spine_rows(length), KEYED)
    marks = stage.save(_marks(_resolved(keyed)), "marks")
    runs = marks.groupBy("th").agg(F.collect_set(F.struct("start", "count", "sure", "spine")).alias("runs"))
    # one row for each text; copies meet in their tasks before the shuffle
    once = long_.groupBy("th").agg(F.first("text").alias("text"))
    held = stage.save(once.join(runs, "th").select("th", "text", "runs"), "held")
    single = _resolved(held.mapInArrow(_string_rows(length), KEYED))
    found = single.where((F.col("n_g") >= 2) | (F.col("run").bitwiseAND(1) == 1)).select("th", F.shiftright("run", _START).alias("start"))
    return held, found.groupBy("th").agg(F.collect_set("start").alias("starts"))


def _spans(held: DataFrame, singles: DataFrame, length: int) -> DataFrame:
    joined = held.select("th", "runs").join(singles, "th", "left").select("th", "runs", "starts")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for runs_, starts in zip(batch.column("runs"), batch.column("starts"), strict=True):
                sure = runs_.values.field("sure").to_numpy(zero_copy_only=False).astype(bool)
                start, count = (runs_.values.field(k).to_numpy()[sure].astype(np.int64) for k in ("start", "count"))
                if starts.is_valid:
                    more = starts.values.to_numpy().astype(np.int64)
                    start, count = np.concatenate((start, more)), np.concatenate((count, np.ones(len(more), np.int64)))
                a, b = covered(start, count, length)
                out.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            spans_ = pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("th"), spans_], names=["th", "spans"])

    return joined.mapInArrow(spans, "th long, spans array<struct<start: long, stop: long>>").where(F.size("spans") > 0)


def repeated_spans(docs: DataFrame, stage: Stage, key: Column, text_col: str = "text", length: int = 400) -> DataFrame:
    """``(th, spans)`` for each distinct text with repeated bytes; spans are byte offsets ``(start, stop)``,
    ordered. ``th`` is the text's ``key``, made by ``text_key``. Stored as "spans": each table is deleted when the next
    is written, and the shuffle of the single strings before texts are shuffled."""
    held, singles = _judged(docs, stage, key, text_col, length)
    stage.drop("marks")
    singles = stage.save(singles, "singles")
    spans = stage.save(_spans(held, singles, length), "spans")
    stage.drop("held")
    stage.drop("singles")
    return spans


def _outside(raw: bytes, cuts: list[dict], whole: bool) -> bytes:
    """The bytes outside the cuts; with ``whole``, a character that a cut splits stays."""
    at, kept = 0, []
    for cut in cuts:
        a, b = cut["start"], cut["stop"]
        while whole and a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while whole and b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _keep_rest(texts: pa.Array, spans: pa.Array, whole: bool = True) -> pa.Array:
    """The texts without their spans: strings whose characters stay whole, or exact bytes."""
    out = []
    for value, cuts in zip(texts.cast(pa.large_binary()), spans, strict=True):
        raw = value.as_py()
        out.append(raw if raw is None or not cuts.is_valid else _outside(raw, cuts.as_py(), whole))
    return pc.cast(pa.array(out, pa.large_binary()), pa.string() if whole else pa.binary())


def removed_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Per row: id, ``spans`` (what is removed, as in ``repeated_spans``; empty if nothing), ``kept`` (the exact bytes
    that stay) and ``text`` (the same as a string, in which a character that a span splits stays whole)."""
    stage = Stage(docs.sparkSession, "passages")
    key = text_key(docs, text_col, stage)
    spans = repeated_spans(docs, stage, key, text_col, length)
    # spans are small and go to all parts of their text's rows, so that no text with many copies meets in one task
    spread = spans.select("th", "spans", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    rows = docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("whole"), key.alias("th"), F.pmod(F.xxhash64(id_col), F.lit(PARTS)).cast("int").alias("part"))

    @F.arrow_udf("struct<kept: binary, text: string>")
    def cut(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([_keep_rest(texts, spans_, whole=False), _keep_rest(texts, spans_)], names=["kept", "text"])

    # texts that stay as they are do not go to Python
    judged = rows.join(spread.hint("merge"), ["th", "part"], "left").withColumn("left", cut(F.when(F.col("spans").isNotNull(), F.col("whole")), F.col("spans")))
    kept = F.when(F.col("spans").isNull(), F.col("whole").cast("binary")).otherwise(F.col("left.kept"))
    text = F.when(F.col("spans").isNull(), F.col("whole")).otherwise(F.col("left.text"))
    return judged.select(id_col, F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"), kept.alias("kept"), text.alias("text"))


def digests() -> list[Column]:
    """n_bytes, n_removed, n_spans and kept_sha256 of the rows of ``removed_passages``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    n_bytes = F.octet_length("kept") + removed
    return [n_bytes.alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    return removed_passages(docs, id_col, text_col, length).select(id_col, *digests())


def without_passages(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """The rows with repeated passages taken out of ``text_col``; characters stay whole; other columns as they were."""
    stage = Stage(docs.sparkSession, "passages")
    key, (th, cuts) = text_key(docs, text_col, stage), free_names(docs, "th", "cuts")
    spans = repeated_spans(docs, stage, key, text_col, length).select(F.col("th").alias(th), F.col("spans").alias(cuts))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        return _keep_rest(texts, spans_)

    joined = docs.withColumn(th, key).join(spans, th, "left")
    return joined.withColumn(text_col, F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col(cuts)))).select(docs.columns)
