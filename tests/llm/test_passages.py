from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import pytest

from driftglass.llm import passages


def _brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _texts():
    rng = random.Random(5)
    words = [w + s for w in ("thé", "on", "ation", "ly", "er", "ñu") for s in ("", "a", "ing", "tion", ".")]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    shared = [prose(n) for n in (60, 75, 90, 200)]
    texts = []
    for i in range(60):
        t = prose(rng.randrange(5, 200))
        for s in rng.sample(shared, rng.randrange(0, 3)):
            cut = rng.randrange(0, 150)
            t = t + rng.choice(["", " ", "x"]) + s[cut : len(s) - rng.randrange(0, 150)] + prose(rng.randrange(0, 40))
        texts.append(t)
    base = prose(300)
    for _ in range(25):
        t = list(base)
        for _ in range(rng.randrange(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("qzXé")
        texts.append("".join(t))
    texts += [None, "", "a" * 399, "a" * 400, "a" * 401, "ab" * 450, "b" + "ab" * 300, prose(30) * 3, texts[0], texts[0], "tail " + texts[0][-420:], texts[1][:405]]
    return texts


@pytest.mark.parametrize("piece,fold", [(1 << 20, 1 << 20), (700, 50)])
def test_digest_matches_brute_force(spark, monkeypatch, piece, fold):
    texts = _texts()
    monkeypatch.setattr(passages, "PIECE", piece)
    monkeypatch.setattr(passages, "FOLD", fold)
    rows = [(i if i % 9 else None, t, "th", [i]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string, spans array<int>").repartition(3)
    got = Counter(tuple(r) for r in passages.dedup_digest(docs).collect())
    want = Counter((i if i % 9 else None, *b) for i, b in enumerate(_brute(texts, 400)))
    assert got == want


def test_parser_in_pieces(monkeypatch):
    """The same runs whatever the pieces: no string is asked twice and none is lost."""
    import numpy as np
    import pyarrow as pa

    text = pa.array(_texts()[60:64] + ["ab" * 900])
    found = []
    for piece in (1 << 20, 500, 37):
        monkeypatch.setattr(passages, "PIECE", piece)
        parser = passages.Parser(400)
        runs = set()
        for data, row, offset, places in passages._buffers(text, parser):
            spine, margins, owner, start, count = parser.spines(data, *places)
            new = set(zip(row[owner].tolist(), (start - places[3][owner] + offset[owner]).tolist(), count.tolist(), spine.tolist(), margins.tolist(), strict=True))
            assert not new & runs
            runs |= new
        covered = np.concatenate([np.arange(s, s + c) + r * 10**6 for r, s, c, *_ in runs])
        assert len(covered) == len(set(covered.tolist())) == sum(max(len(t.as_py().encode()) - 399, 0) for t in text)
        found.append(runs)
    assert found[0] == found[1] == found[2]


def test_cut_text_stays_readable(spark):
    shared = "é" * 250
    docs = spark.createDataFrame([(1, "a" + shared + "b", "en"), (2, "cc" + shared + "dd", None), (3, "clean", "en"), (4, None, "en")], "doc_id long, text string, _th string")
    got = {r.doc_id: r.text for r in passages.without_passages(docs).collect()}
    assert got == {1: "ab", 2: "ccdd", 3: "clean", 4: None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert passages.dedup_digest(docs).count() == 0


def test_query_returns_the_text_that_stays(spark, tmp_path):
    """A reader sees what was removed: passages of 400 bytes or more are gone from the text, all else is still there."""
    from driftglass.llm import queries

    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passage, short, accents, clean = prose(60), prose(49), "é" * 250, prose(80) + " né"
    assert len(passage) >= 400 > len(short)
    texts = [f"one {passage} 1", f"two {passage} 2", f"three {short} 3", f"four {short} 4", clean, None, f"ũ{accents}a", f"é{accents}b", *[passage + "tail"] * 40]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_repeated_passages(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(_brute(texts, 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
    assert [passage in got[i].text for i in (0, 1)] == [False, False]
    assert [got[i].text for i in (0, 1)] == ["one1", "two2"]
    assert [got[i].text for i in (2, 3, 4, 5)] == [texts[2], texts[3], clean, ""]
    assert {got[i].text for i in range(8, len(texts))} == {""}
    # the span begins inside the character, which stays whole in the text and is cut in the bytes
    assert (got[6].text, got[6].n_bytes - got[6].n_removed, got[7].text) == ("ũa", 2, "b")


def test_tables_are_deleted_before_the_texts_are_shuffled(spark):
    """What is left to run for the stage's result joins the texts with their stored spans; nothing else is kept."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(_texts())], "doc_id long, text string")
    before = {p.name for p in _shared(spark).iterdir()}
    left = passages.without_passages(docs)
    assert [p.name for d in _shared(spark).iterdir() if d.name not in before for p in d.iterdir()] == ["spans"]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Join") == 1


def _shared(spark):
    return Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
