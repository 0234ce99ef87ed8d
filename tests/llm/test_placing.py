"""Sharding, mixing, URL rules and chat formatting."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftglass.llm import chat, mixing, sharding, url_filter


@given(st.lists(st.integers(1, 60), min_size=1, max_size=14), st.integers(1, 6))
def test_smallest_capacity(sizes, shards):
    def best(rest, k):
        if k == 1 or len(rest) <= 1:
            return sum(rest)
        return min(max(sum(rest[:i]), best(rest[i:], k - 1)) for i in range(1, len(rest) + 1))

    capacity = sharding.smallest_capacity(sizes, shards)
    if len(sizes) <= 9:
        assert capacity == best(sizes, shards)
    cuts = [0, *sharding.cut(sizes, shards), len(sizes)]
    assert len(cuts) <= shards + 1 and cuts == sorted(cuts)
    assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) <= capacity


def test_shards(spark, monkeypatch):
    rows = [(i, "x" * (i % 300) + str(i % 700), i) for i in range(1500)] + [(5000 + i, "hot text", i) for i in range(700)]
    rows += [(9000, None, 1), (9001, "", 1), (None, "n", 1), (7, "again", 1), (7, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(5)
    got = sharding.by_bytes(docs, 8).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, load, home = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        home[r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert all(len(s) == 1 for s in home.values())
    assert max(load.values()) < 1.15 * sum(load.values()) / 8
    assert sharding.by_bytes(docs.limit(0), 8).count() == 0


@settings(deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6))
def test_schedule_stays_within_a_block(weights):
    slots, period = mixing.schedule(weights), sum(weights)
    assert sorted(t for s in slots for t in s) == list(range(period))
    for w, s in zip(weights, slots, strict=True):
        for t in range(period + 1):
            assert abs(sum(x < t for x in s) - t * w / period) < 1
        assert all(r <= t < d for t, (r, d) in zip(s, mixing.windows(w, period), strict=True))


def test_mixing(spark):
    rows = [(i, "a" if i % 2 else f"s{i % 5}", f"t{i}", i) for i in range(900)] + [(None, None, None, 1), (None, None, None, 1), (3, "a", "t3", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, slot int").repartition(4)
    weights = {"a": 3, "s0": 2, "s2": 1}
    got = mixing.interleave(docs, weights, block_rows=16).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, s, *_ in rows)
    assert sorted(r.position for r in got) == list(range(len(rows)))
    blocks = {(r.slot, r.source, r.block, r.phase) for r in got}
    assert sorted(b[0] for b in blocks) == list(range(len(blocks)))
    for phase in {b[3] for b in blocks}:
        part = sorted(b for b in blocks if b[3] == phase)
        active = {b[1] for b in part}
        total = sum(weights.get(s, 1) for s in active | {s for s in {x[1] for x in blocks} if any(b[1] == s and b[3] >= phase for b in blocks)})
        done = Counter()
        for t, (_, source, *_) in enumerate(part):
            done[source] += 1
            for s in active:
                assert abs(done[s] - (t + 1) * weights.get(s, 1) / total) < 1
    ordered = mixing.in_order(docs, weights, 16).select("doc_id", "source", "slot", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")).collect()
    assert Counter((r.doc_id, r.source, r.slot) for r in ordered) == Counter((i, s, k) for i, s, _, k in rows)
    assert mixing.interleave(docs.limit(0)).count() == 0


RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def brute_rule(url):
    host, path = split(url)
    fits = [(len(r), r, v) for r, v in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules(spark):
    urls = [f"{s}://{h}/{la}/{n}{t}" for s in ("http", "https") for h in ("a.example.com", "example.net", "m.x.org", "X.EXAMPLE.Com", "notcom", "com") for la in ("en", "de", "es") for n in (7, 81, 9) for t in ("", "?a=1&b=2", "#t", "/")]
    urls += [None, "", "no scheme", "http://", "://com/en/", "http://é.com/en/x", "a://b://com/en/", "http://com?/en/", "x\n://com/en/\n", "HTTP://COM/en/"] + ["http://com/" + "en/" * 40_000]
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)] + [(None, urls[0], None, None), (0, urls[0], "h", "p")], "page_id long, url string, host string, html string")
    got = url_filter.judge(pages, RULES, trees=2, depth=2)
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict", "block_score"]
    found = got.collect()
    assert len(found) == len(urls) + 2
    for r in found:
        rule, verdict = brute_rule(r.url)
        assert (r.host, r.path) == split(r.url) and r.rule == rule and r.verdict in ("allow", "block")
        assert r.verdict == verdict if rule else r.block_score is not None
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    one_kind = url_filter.judge(pages, [("com/", "block")]).where("page_id = 5").collect()
    assert all(r.verdict == "block" for r in one_kind)


def test_trees_learn_held_out_urls(spark):
    rng = np.random.default_rng(0)
    urls = [(i, f"http://{'spam' if i % 2 else 'good'}{rng.integers(9)}.example.{'org' if i % 2 else 'net'}/{'x' if i % 3 else 'en'}/{rng.integers(10**6) if i % 2 else 'page'}", i % 2) for i in range(600)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in urls], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, [("org/en/", "block"), ("net/en/", "allow")]).where("rule is null").collect()}
    assert got and np.mean([(v == "block") == bool(i % 2) for i, v in got.items()]) > 0.95


TURNS = ["", "plain", "</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "<|||<|", "<", "||<|", " lead\n\n", "é 中文 😀 ", "a<|end|>", None]


def test_chat_round_trip(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(40):
        for t in range(rng.integers(1, 8)):
            rows.append((c, t, ["system", "user", "assistant"][rng.integers(3)], "".join(x or "" for x in rng.choice(TURNS, 3)) if rng.random() < 0.8 else TURNS[rng.integers(len(TURNS))], "z"))
    rows += [(None, 0, "assistant", "no id", "z"), (50, 1, None, None, "z"), (50, 1, "assistant", "tie", "z"), (50, 1, "assistant", "tie", "z"), (50, None, "assistant", "first", "z"), (51, 0, "assistant", "long " * 50_000, "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string").repartition(3)
    formatted = chat.format_conversations(turns, public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t, role is not None, role, text is not None, text))
    assert set(got) == set(by)
    for c, ts in by.items():
        told = [(x[3] or "", x[5] or "") for x in sorted(ts, key=lambda x: tuple(str(v) if isinstance(v, str) else (v if v is not None else -1) for v in (x[0], x[1] or 0, x[2], x[3] or "", x[4], x[5] or "")))]
        loss = "".join(t for r, t in told if r == "assistant")
        r = got[c]
        assert r.n_turns == len(told) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in told).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_conversations(turns.limit(0), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


@given(st.text("<|ab end>\\", max_size=30))
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(mark in chat.escape(text) for mark in (chat.TURN, chat.TEXT, chat.END))


@pytest.mark.parametrize("path", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_respect_turns(path):
    tokenizer = chat.chat_tokenizer(public_tokenizers.path(path))
    text, spans = chat.render([("user", " a\n"), ("assistant", "\n b "), ("assistant", "")], "assistant")
    found = tokenizer.encode(text, add_special_tokens=False)
    offsets = np.array(found.offsets).reshape(-1, 2)
    assert len(spans) == 1
    for (a, b), (lo, hi) in zip(chat.token_spans(offsets, spans), spans, strict=True):
        assert offsets[a][0] >= lo and offsets[b - 1][1] <= hi
