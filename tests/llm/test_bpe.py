from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftglass.llm import bpe, queries

FILES = (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True))
TEXTS = ["", None, "  a  b \n", "<|endoftext|>x<|startoftext|> y<|endoftext|", "don't I'LL 12345 İstanbul ΣΑΣ é á 中文 字", "ﬁ ẞ ǅ Ω 5½ x² ١٢ 🙂🙂", "\x00\x1c x\u0085y", "a" * 30_000, "ab" * 15_000, "thethethe" * 4_000, "?!" * 9_000]


@pytest.fixture(scope="module", params=FILES, ids=lambda f: f[0])
def coder(request):
    name, spaced = request.param
    path = public_tokenizers.path(name)
    return bpe.BacktrackingMemo(path, spaced), bpe.Decoder(path), Tokenizer.from_file(path)


def both(coder, texts):
    memo, decoder, _ = coder
    ids, decoded = [], []
    for some, ends in memo.encode(pa.array(texts, pa.string())):
        ids += [some[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        decoded += decoder.decode(some, ends).to_pylist()
    return ids, decoded


def check(coder, texts):
    ids, decoded = both(coder, texts)
    library = coder[2]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert ids == want
    assert decoded == [library.decode(x, skip_special_tokens=False) for x in want]


def test_hostile_texts_equal_library(coder):
    check(coder, TEXTS * 2)


def test_random_texts_equal_library(coder):
    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.one_of(st.text(max_size=50), st.text("abeinrst", max_size=80), st.text("a b'\né1?", max_size=60)), max_size=5))
    def same(texts):
        check(coder, texts)

    same()
    r = random.Random(3)
    check(coder, ["".join(r.choice(letters) for _ in range(200)) for letters in ("ab", "aeinorst", "0123456789", "!?-_=", "éñß", "中文字") for _ in range(60)])


def test_every_token_and_pairs_of_tokens(coder):
    """Texts of single tokens and of two tokens in a row, where merges may cross."""
    _, decoder, library = coder
    pieces = [library.decode([i]) for i in range(0, library.get_vocab_size(), 7)]
    plain = [p.removesuffix("</w>") for p in pieces]
    check(coder, plain)
    r = random.Random(5)
    check(coder, [r.choice(plain) + r.choice(plain) for _ in range(4_000)])


def test_pair_table_equals_merging(coder):
    """Compatible pairs are those that plain merging leaves as they are."""
    merger = coder[0].merger
    rank = merger.rank

    def merged(parts):
        made = {pair: t for t, pair in by_token.items()}
        while True:
            found = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank), default=None)
            if found is None:
                return parts
            i = found[1]
            parts = [*parts[:i], made[parts[i], parts[i + 1]], *parts[i + 2 :]]

    with open(public_tokenizers.path(FILES[0][0] if merger.suffix else FILES[1][0]), encoding="utf-8") as file:
        model = json.load(file)["model"]
    by_token = {}
    for m in model["merges"][:3_000]:
        a, b = m.split(" ") if isinstance(m, str) else m
        by_token[model["vocab"][a + b]] = (model["vocab"][a], model["vocab"][b])
    rank = {pair: merger.rank[pair] for pair in by_token.values()}
    full = merger.rank
    merger.rank, merger.pairs = rank, {}
    try:
        letters = lambda t: letters(by_token[t][0]) + letters(by_token[t][1]) if t in by_token else [t]
        r, tokens = random.Random(1), sorted(by_token)
        for _ in range(3_000):
            a, b = r.choice(tokens), r.choice(tokens)
            assert merger.compatible(a, b) == (merged(letters(a) + letters(b)) == [a, b])
    finally:
        merger.rank, merger.pairs = full, {}


def test_operator_edges_and_query(spark, tmp_path):
    path = public_tokenizers.path(FILES[0][0])
    library = Tokenizer.from_file(path)
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "null id", "x", "y"), (3, "again", "x", "y"), (3, "again", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, id string")
    got = sorted(((r.id, bytes(r.ids), r.text) for r in bpe.encode(docs, path, spaced=False, decoded=True).collect()), key=str)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids
    assert got == sorted(((i, np.array(ids(t), "<u4").tobytes(), library.decode(ids(t), skip_special_tokens=False)) for i, t, *_ in rows), key=str)
    again = bpe.decode(bpe.encode(docs, path, spaced=False), path)
    assert sorted(((r.id, r.text) for r in again.collect()), key=str) == sorted(((i, t) for i, _, t in got), key=str)
    assert bpe.encode(docs.limit(0), path, spaced=False).collect() == []
    assert bpe.decode(spark.createDataFrame([(1, None)], "id long, ids binary"), path).collect()[0].text == ""
    unknown = spark.createDataFrame([(1, np.array([320, 99_999_999, 320], "<u4").tobytes())], "id long, ids binary")
    assert bpe.decode(unknown, path).collect()[0].text == library.decode([320, 320])

    documents = "/root/testdata/sf0.001/documents.parquet"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(documents, columns=["doc_id", "text"]).to_pylist()}
    rows = queries.op11_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ids(texts[r.doc_id])
        decoded = library.decode(want, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_vocabularies_that_cannot_be_walked_are_refused():
    letters = {c: i for i, c in enumerate(bpe._byte_letters().values())}
    spec = {"model": {"vocab": letters | {"ab": 256, "abc": 257, "bc": 258}, "merges": ["a b", "ab c", "b c", "a bc"]}}
    with pytest.raises(ValueError, match="one merge"):
        bpe.Backtracker(spec)
    with pytest.raises(ValueError, match="plain"):
        bpe.Backtracker({"model": spec["model"] | {"dropout": 0.1}})


def test_tokens_that_do_not_encode_to_themselves_are_not_used():
    letters = {c: i for i, c in enumerate(bpe._byte_letters().values())}
    # "abc" would be "a" + "bc", but "ab" comes first and is never "bc" again
    spec = {"model": {"vocab": letters | {"ab": 256, "bc": 257, "abc": 258}, "merges": ["a b", "b c", "a bc"]}}
    coder = bpe.Backtracker(spec)
    assert 258 not in coder.size
    assert coder.encode("abc") == [256, letters["c"]]
    assert coder.encode("bcabc") == [257, 256, letters["c"]]
