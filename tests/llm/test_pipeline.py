"""The pipeline's stages, each on its own input, against brute force; and the whole run."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftglass.llm import mixing, stages
from driftglass.llm.common import Stage


def corpus():
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("thé", "lo", "ver", "ing", "na", "eau", "ción") for b in ("", "st", "er", "ation", "li", "os", "ung", "ti", "ne", "ra")]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + "."
    rows = [[i, prose(rng.randrange(60, 220)), "en", f"src{i % 5 if i % 3 else 0}"] for i in range(120)]
    rows += [[200 + i, rows[i][1], "en", "src1"] for i in range(12)]  # exact copies
    for i in range(12, 24):  # near copies
        t = rows[i][1].split(" ")
        t[len(t) // 2] = "changed"
        rows.append([300 + i, " ".join(t), "en", "src2"])
    shared = prose(70)
    for i in range(30, 36):  # a passage in several documents
        rows[i][1] += "\n" + shared + "\n" + prose(30)
    junk = [" ".join(f"{rng.choice(words).upper()}!!%%" for _ in range(120)) for _ in range(20)]
    rows += [[400 + i, t, "en", "src3"] for i, t in enumerate(junk)]
    rows += [[500, None, "en", "src0"], [501, "too short", "en", None], [502, "again " * 200, "en", "src0"], [None, prose(80), None, "src4"]]
    rows = [(*r, len(r[1] or "")) for r in rows]
    labels = [(i, 1, 0) for i in range(0, 100, 2)] + [(400 + i, 0, 0) for i in range(10)]
    return rows, labels, shared


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rows, labels, _ = corpus()
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def repeated(texts, length):
    raw = {i: t.encode() for i, t in texts}
    seen = Counter(r[p : p + length] for r in raw.values() for p in range(len(r) - length + 1))
    out = {}
    for i, r in raw.items():
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        at, kept = 0, []
        while at < len(r):  # characters stay whole
            end = at + 1
            while end < len(r) and r[end] & 0xC0 == 0x80:
                end += 1
            if not all(gone[at:end]):
                kept.append(r[at:end])
            at = end
        out[i] = b"".join(kept).decode()
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = stages.quality_rules(spark, docs, sf_dir).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns
    assert set(range(120)) <= ids and None in ids and not ids & {*range(400, 420), 500, 501, 502}

    unique = stages.drop_near_duplicates(spark, kept, sf_dir).cache()
    left = {r.doc_id for r in unique.collect()}
    assert unique.columns == columns and left == ids - set(range(200, 212)) - set(range(312, 324))

    cut = stages.drop_passages(spark, unique, sf_dir).cache()
    assert cut.columns == columns
    want = repeated([(r.doc_id, r.text) for r in unique.collect()], stages.PASSAGE)
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got == want and sum(len(got[i]) < len(r.text) for r in unique.collect() for i in [r.doc_id]) >= 6
    shared = corpus()[2]
    assert not any(shared in t for t in got.values())

    mixed = stages.mix_sources(spark, cut, sf_dir)
    assert mixed.columns == columns and Counter(map(tuple, mixed.collect())) == Counter(map(tuple, cut.collect()))


def test_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "suffix-array dedup", "mixing sources to target weights", "packing"]
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} >= set(range(120)) and not {r.doc_id for r in pieces} & {*range(200, 212), *range(312, 324), *range(400, 420)}
    total = Counter()
    for r in pieces:
        total[r.doc_id] += len(r.ids) // 4
    assert all(total[r.doc_id] == r.doc_tokens for r in pieces)
    by = Counter()
    for r in pieces:
        by[r.sequence_id] += len(r.ids) // 4
    assert all(by[r.sequence_id] == r.sequence_tokens <= 4096 for r in pieces)
    assert all(n == 4096 or n & (n - 1) == 0 for n in by.values())


def test_one_row_of_each_group_stays(spark, tmp_path):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(2000)]
    prose = [" ".join(rng.choices(words, k=90)) for _ in range(7)]
    rows = [(1, prose[0]), (1, prose[0]), (None, prose[0])]  # a repeated row and a copy without an id
    rows += [(2, prose[1]), (2, prose[2]), (3, prose[2])]  # an id with two texts, one of them with a copy
    rows += [(None, prose[3]), (None, prose[3]), (None, prose[4])] + [(9, prose[5]), (8, prose[5]), (7, prose[6])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    unique = stages.drop_near_duplicates(spark, docs, "")
    want = Counter([(1, prose[0]), (2, prose[1]), (2, prose[2]), (None, prose[3]), (None, prose[4]), (8, prose[5]), (7, prose[6])])
    assert Counter((r.doc_id, r.text) for r in unique.collect()) == want
    unique.write.parquet(f"{tmp_path}/unique")
    cut = stages.drop_passages(spark, spark.read.parquet(f"{tmp_path}/unique"), "")
    assert Counter((r.doc_id, r.text) for r in cut.collect()) == want
    pieces = stages.pack(spark, cut, "").collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter(i for i, _ in want) and all(r.doc_tokens > 90 for r in pieces)


def test_packing_follows_the_mix(spark, tmp_path):
    rng = random.Random(3)
    # later positions have longer texts, so their files are the larger ones
    plain = spark.createDataFrame([(i, f"t{i}", "a" if i % 4 else "b") for i in range(1500)], "doc_id long, text string, source string")
    mixed = mixing.in_order(plain).collect()
    long_ = {r.doc_id: " ".join(str(rng.random()) for _ in range(2 + n // 20)) for n, r in enumerate(mixed)}
    docs = spark.createDataFrame([(i, long_[i], "a" if i % 4 else "b") for i in range(1500)], "doc_id long, text string, source string")
    position = {r.doc_id: r.position for r in mixing.interleave(docs.withColumn("_text", F.xxhash64("text")), tie=["_text"]).collect()}
    parts = {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stages.mix_sources(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
        for r in stages.pack(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect():
            parts.setdefault(r.sequence_id >> 40, set()).add(position[r.doc_id])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = [parts[p] for p in sorted(parts)]
    assert len(order) > 1 and sum(map(len, order)) == 1500
    assert all(max(x) < min(y) for x, y in zip(order, order[1:], strict=False))


def test_packing_leaves_no_words_in_its_workers(spark):
    """Workers idle on beside the next stage; what they remember counts for its executors' memory."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit("qzx"), F.sha1(F.concat_ws("-", "id", F.lit(k)))) for k in range(20))).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(1).alias("n_chars"))
    pieces = stages.pack(spark, docs, "").collect()
    assert sum(len(r.ids) // 4 for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0) and len({r.doc_id for r in pieces}) == 400

    def remembered(batches):
        import pyarrow as pa

        from driftglass.llm import word_memo

        for _ in batches:
            memos = [d for m in word_memo._MEMO.values() for g in (m.pre_tokens, m.after_space, m.words) for d in (g, g.older)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(w.lower().startswith("qzx") for d in memos for w in d)])], names=["n"])

    assert {r.n for r in spark.range(0, 64, 1, 16).mapInArrow(remembered, "n long").collect()} == {0}


def test_shuffle_files_go_when_a_table_stands(spark):
    """They are deleted with the write and do not wait for the driver's garbage collection."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    Stage(spark, "test").save(spark.range(1000).repartition(4, "id"), "rows")
    until = time.time() + 5
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
