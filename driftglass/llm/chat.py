"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: ``<|turn|>role<|text|>text<|end|>`` for each turn. In roles and texts each ``<|`` gets
one more bar, so no control string can come from a text and the rendering can be undone. The rendering is encoded once
with offsets; the control strings are added to the tokenizer as tokens of their own, so no token crosses a turn's
bounds. The tokens of each masked turn are found by binary search of its span among the token offsets.

Rows are sorted by conversation and turn within their partitions and stream through a task one conversation at a time:
a task holds the largest conversation, which is the unit of the result, and no other.

Edge cases: a null role or text is empty; turns with equal or null numbers are ordered by number (nulls first), role and
text; repeated rows are turns of their own; a null id is a conversation; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)
SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
SCHEMA = "conv_id long, formatted string, ids array<int>, loss_tokens array<struct<start: long, stop: long>>, loss_chars array<struct<start: long, stop: long>>"


def escape(text: str | None) -> str:
    return (text or "").replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def render(turns: list[tuple[str | None, str | None]], masked: str) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans of the texts whose role is ``masked``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        parts += [head, body, END]
        if role == masked and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def chat_tokenizer(path: str):
    """The public vocabulary with the control strings as tokens; offsets cover leading blanks."""
    from tokenizers import AddedToken, Tokenizer

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    for part in ("pre_tokenizer", "post_processor"):
        if spec.get(part) and "trim_offsets" in spec[part]:
            spec[part]["trim_offsets"] = False
    # special tokens of the vocabulary may stand in texts; only ours are control strings
    spec["added_tokens"] = []
    tokenizer = Tokenizer.from_str(json.dumps(spec))
    tokenizer.add_tokens([AddedToken(x, normalized=False, lstrip=False, rstrip=False, single_word=False) for x in (TURN, TEXT, END)])
    return tokenizer


def token_spans(offsets: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of tokens [from, to) that meet each character span; both are sorted."""
    if not spans:
        return []
    first = np.searchsorted(offsets[:, 1], [a for a, _ in spans], "right")
    last = np.searchsorted(offsets[:, 0], [b for _, b in spans], "left")
    return list(zip(first.tolist(), last.tolist(), strict=True))


def format_conversations(turns: DataFrame, tokenizer: str, masked: str = "assistant") -> DataFrame:
    """One row per conversation: the rendering, its ids, and the loss mask as runs of tokens and of characters (code
    points); both cover the masked texts and nothing else."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chat_tokenizer(tokenizer)
        each = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        out, size = [], 0
        for conv, group in groupby(each, key=lambda r: r[0]):
            text, spans = render([(role, body) for _, role, body in group], masked)
            found = encode.encode(text, add_special_tokens=False)
            offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
            runs = token_spans(offsets, spans)
            chars = [(int(offsets[a, 0]), int(offsets[b - 1, 1])) for a, b in runs]
            out.append((conv, text, found.ids, runs, chars))
            size += len(text)
            if size > 1 << 20:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role"), F.col("text"), F.col("turn"))
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(rows, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    spans = lambda column: pa.array([[{"start": a, "stop": b} for a, b in x] for x in column], pa.list_(SPAN))
    conv, text, ids, runs, chars = zip(*rows, strict=True)
    arrays = [pa.array(conv, pa.int64()), pa.array(text, pa.string()), pa.array(ids, pa.list_(pa.int32())), spans(runs), spans(chars)]
    return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "formatted", "ids", "loss_tokens", "loss_chars"])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the output alone: turns and masked text, unescaped, as digests."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                turns = parse(row["formatted"])
                told = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                loss = "".join(unescape(row["formatted"][s["start"] : s["stop"]]) for s in row["loss_chars"])
                masked = sum(s["stop"] - s["start"] for s in row["loss_tokens"])
                out.append((row["conv_id"], len(turns), told, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"]), len(row["ids"]), masked))
            names = [x.split()[0] for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, zip(*out, strict=True) if out else [[]] * len(names), strict=True)], names=names)

    return formatted.mapInArrow(rows, DIGEST)
