from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftglass.llm import packing, token_planes, word_memo
from driftglass.llm.common import Stage

FILES = (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True))
TEXTS = ["  a  b   c \n d  e <|endoftext|> don't I'LL x'S 12345 İstanbul ΣΑΣ é á   中文 字 a\t\tb ", " lead", "trail ", "\n\n x\n y", "", "a\u0085 b", "\x1c x \x1f y", "word　 wide", "ﬁ ẞ ǅ Ω 5½ x² ١٢", "Thingou erat, le queéle.\nÉai öbe ñja! " * 300]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def encoded(memo, texts, end_id=None):
    """The ids of each text as bytes."""
    found = []
    for ids, ends in memo.encode(pa.array(texts, pa.string()), end_id):
        found += [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return found


@pytest.mark.parametrize("name,spaced", FILES)
def test_memo_equals_library(name, spaced, monkeypatch):
    monkeypatch.setattr(word_memo, "MOST", 50)
    memo, tokenizer = word_memo.WordMemo(public_tokenizers.path(name), spaced), library(name)

    ids = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    words = st.text(" \n\t ab'sé1.É中", max_size=60)
    special = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "a", " b", "\n"]), max_size=8).map("".join)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.one_of(st.text(max_size=60), words, special), max_size=6))
    def same(texts):
        assert encoded(memo, texts) == [ids(t) for t in texts]

    same()
    assert encoded(memo, TEXTS * 2 + [None], 7) == [ids(t) + b"\7\0\0\0" for t in [*TEXTS * 2, ""]]
    monkeypatch.setattr(word_memo, "SLICE", 40)
    assert encoded(memo, TEXTS * 2) == [ids(t) for t in TEXTS * 2]
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]  # every letter that the pattern may take
    assert encoded(memo, [f"x {c}{c}a. {c}" for c in letters]) == [ids(f"x {c}{c}a. {c}") for c in letters]


@pytest.mark.parametrize("name,spaced", FILES)
def test_whole_table_equals_library(name, spaced):
    """Every text of the smallest table, ids by the unmodified library."""
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()
    memo, tokenizer = word_memo.WordMemo(public_tokenizers.path(name), spaced), library(name)
    assert encoded(memo, texts) == [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def documents(spark):
    rows = [(i, TEXTS[i % len(TEXTS)] * (1 + i % 3), "x", 7) for i in range(40)]
    rows += [(None, "no id", "x", 1), (None, None, None, 1), (3, TEXTS[3], "x", 1), (50, None, "x", 1), (-5, "first " * 40_000, "x", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string, start int").repartition(3)


def test_files_round_trip(spark, monkeypatch):
    rows, docs = documents(spark)
    tokenizer = library("byte_bpe_50k.json")
    for bits in (False, True):
        monkeypatch.setattr(token_planes, "BLOCK", 1000)
        stage = Stage(spark, "test")
        token_planes.write(docs, f"{stage.root}/files", public_tokenizers.path("byte_bpe_50k.json"), 0, bits=bits)
        got = token_planes.read_digests(spark, f"{stage.root}/files", stage).collect()
        assert len(got) == len(rows)
        want = defaultdict(list)
        for i, text, *_ in rows:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
            want[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at = 0
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.id]
            want[r.id].remove((r.n_tokens, r.ids_crc32))
            at += r.n_tokens
        order = [r.id for r in sorted(got, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i))
    empty = docs.limit(0)
    token_planes.write(empty, f"{stage.root}/none", public_tokenizers.path("byte_bpe_50k.json"), 0)
    assert token_planes.read_digests(spark, f"{stage.root}/none", stage).count() == 0


@given(st.binary(max_size=50), st.binary(max_size=3000))
def test_combined_crc(a, b):
    assert token_planes.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=70), st.booleans())
def test_planes(ids, bits):
    assert token_planes.from_planes(token_planes.to_planes(np.array(ids, np.uint32), bits), len(ids), bits).tolist() == ids


def check_packed(rows, limits, want):
    """Every id once, gapless sequences within all limits; returns the padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        pieces[r["id"]].append(r)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) > 0
            at += len(r["ids"]) // 4
        assert at == rs[0]["sequence_tokens"] <= limits.tokens and len(rs) <= limits.segments and sum(r["loss_tokens"] for r in rs) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    for key, texts in want.items():
        assert sum(len(r["ids"]) for r in pieces[key]) == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[key], key=lambda r: r["start"]):
                assert r["start"] == at and bytes(r["ids"]) == texts[0][4 * at : 4 * at + len(r["ids"])] and r["doc_tokens"] * 4 == len(texts[0])
                at += len(r["ids"]) // 4
    return padding


def test_packing(spark):
    rows, docs = documents(spark)
    memo = word_memo.WordMemo(public_tokenizers.path("word_bpe_49k.json"), False)
    want = defaultdict(list)
    for i, text, *_ in rows:
        want[i].append(encoded(memo, [text], 2)[0])
    limits = packing.Limits()
    got = [r.asDict() for r in packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), 2).collect()]
    assert check_packed(got, limits, want) == 0
    small = packing.Limits(256, 4, 100)
    got = [r.asDict() for r in packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), 2, limits=small, pool=8).collect()]
    check_packed(got, small, want)
    assert packing.pack_texts(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), max_size=60), st.integers(1, 6), st.integers(1, 64), st.integers(1, 20))
def test_packer_keeps_limits(sizes, segments, loss, pool):
    limits = packing.Limits(64, segments, loss)
    examples = [packing._Example(i, os.urandom(4 * n), first) for i, (n, first) in enumerate(sizes)]
    whole = {e.id: [e.ids] for e in examples}
    got = []
    for k, placed in enumerate(packing.Packer(limits, pool).pack(iter(examples))):
        at, total = 0, sum(n for *_, n in placed)
        for e, start, n in placed:
            got.append({"id": e.id, "start": start, "ids": e.ids[4 * start : 4 * (start + n)], "doc_tokens": e.total, "sequence_id": k, "offset": at, "loss_tokens": max(0, start + n - max(start, e.loss_from)), "sequence_tokens": total})
            at += n
    check_packed(got, limits, whole)


def test_violations_are_named(spark):
    """A packing that breaks one limit, or has a gap, is refused."""
    limits = packing.Limits(8, 2, 5)
    piece = lambda seq, offset, n, loss: (seq, offset, bytearray(4 * n), loss)
    rows = [piece(0, 0, 4, 2), piece(0, 4, 4, 3)]  # sound
    rows += [piece(1, 0, 9, 0), piece(2, 0, 1, 0), piece(2, 1, 1, 0), piece(2, 2, 1, 0), piece(3, 0, 4, 4), piece(3, 4, 2, 2), piece(4, 0, 2, 0), piece(4, 3, 1, 0)]
    pieces = spark.createDataFrame(rows, "sequence_id long, offset long, ids binary, loss_tokens long")
    assert {r.sequence_id for r in packing.violations(pieces, limits).collect()} == {1, 2, 3, 4}


def test_default_limits_all_bind(spark):
    """Over documents of the usual lengths no limit is idle, none is broken and nothing is padded."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack_texts(docs.coalesce(1), public_tokenizers.path("word_bpe_49k.json"), 2).cache()
    assert packing.violations(got).isEmpty()
    sums = got.groupBy("sequence_id").agg(F.max("sequence_tokens").alias("n"), F.max("segment").alias("last"), F.sum("loss_tokens").alias("loss")).collect()
    assert all(r.n & (r.n - 1) == 0 for r in sums) and sum(r.n == 4096 for r in sums) > 0.8 * len(sums)
    assert any(r.last == packing.Limits().segments - 1 for r in sums) and any(r.loss == packing.Limits().loss for r in sums)
