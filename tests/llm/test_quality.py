from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from driftglass.llm import quality_llr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in quality_llr.SYMBOLS for c in t), len(lines) - len(set(lines)), len(covered)


def rows():
    rng = random.Random(3)
    good = [f"gut{i}" for i in range(200)]
    bad = [f"BAD{i}!!" for i in range(200)]
    out = []
    for i in range(60):
        words = rng.choices(good if i % 4 else bad, k=rng.randrange(20, 200))
        out.append((i, " ".join(words), "en", i))
    out += [(100, None, "en", 1), (101, "", "en", 1), (102, " \t\n\x0b", "en", 1), (103, "a b c a b c a b c\na b c\n\na b c\n x", "en", 1), (104, "é# | <ü>&\n" * 40, "en", 1)]
    out += [(105, "lang text " * 30_000, "en", 2), (None, "gut1 gut2 " * 60, "en", 2), (3, out[3][1], "en", 3), (3, out[3][1], "en", 3), (106, "\u2003wide\u00a0space b", "x", 1), (107, "a a a a a", "x", 1)]
    return out


def test_judge_matches_brute_force(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, quality string, kept int").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(30)] + [(None, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    got = quality_llr.judge(docs, labels)
    assert got.columns == ["doc_id", "text", "quality", "kept"]
    found = got.collect()
    assert len(found) == len(data)
    # the hash is Spark's own; it is asked for all words and pairs at once
    grams = sorted({g for _, t, *_ in data for w in [WORD.findall(t or "")] for g in [*((x,) for x in w), *zip(w, w[1:], strict=False)]})
    frame = spark.createDataFrame([(list(g),) for g in grams], "g array<string>")
    b = frame.selectExpr("g", f"cast(pmod(if(size(g) = 1, xxhash64(g[0]), xxhash64(g[0], g[1])), {quality_llr.BUCKETS}) as int) as b") if grams else None
    bucket = {tuple(r.g): r.b for r in b.where("size(g) = 1").collect()} | {tuple(r.g): r.b for r in frame.where("size(g) = 2").selectExpr("g", f"cast(pmod(xxhash64(g[0], g[1]), {quality_llr.BUCKETS}) as int) as b").collect()}
    good = {i for i in range(30) if i % 4} | {1}
    raw, target = Counter(), Counter()
    of = lambda t: [bucket[g] for w in [WORD.findall(t or "")] for g in [*((x,) for x in w), *zip(w, w[1:], strict=False)]]
    for i, t, *_ in data:
        raw.update(of(t))
        if i in good:
            target.update(of(t))
    n, m = sum(raw.values()), sum(target.values())
    for r in found:
        q = r.quality
        counts = base(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        buckets = of(r.text)
        score = sum(math.log(target[x] * n / m + quality_llr.PRIOR) - math.log(raw[x] + quality_llr.PRIOR) for x in buckets) / max(1, len(buckets))
        assert q.base_failed == failed and q.score == pytest.approx(score, abs=1e-9)
        assert q.kept == (not failed and q.score >= quality_llr.THRESHOLD)
    clean = [r for r in found if r.text and r.text.startswith("gut") and not r.quality.base_failed]
    junk = [r for r in found if r.text and r.text.startswith("BAD") and not r.quality.base_failed]
    assert clean and junk and all(r.quality.kept for r in clean) and not any(r.quality.kept for r in junk)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame(rows()[:5], "doc_id long, text string, quality string, kept int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.quality.score == 0 for r in quality_llr.judge(docs, none).collect())
    assert quality_llr.judge(docs.limit(0), none).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame(rows()[:5], "doc_id long, text string, quality string, kept int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality_llr.judge(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
