"""Extra columns of any name stay what they are."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftglass.llm import bpe, lexical, mixing, packing, passages, periodic, quality_llr, sharding, simhash, similar, stages, token_planes, url_filter
from driftglass.llm.common import Stage

NAMES = ["_text", "_position", "_th", "_cuts", "_spans", "_llr", "_row", "f_length", "f_one", "_decided", "decided", "row", "features", "p", "_p", "fold", "_s", "_n", "node", "k", "h", "rank", "block", "slot", "_right0", "_cell", "_h", "_rank", "_c", "_before", "th", "llr"]


@pytest.fixture(scope="module")
def docs(spark):
    shared = " ".join(f"w{i}" for i in range(120))
    rows = [(i, f"{i} {i * 7} {shared} {i * 3}" if i % 3 else f"some text {i}", f"s{i % 3}", f"http://a{i}.example.{'com' if i % 2 else 'net'}/en/{i}", *[f"{n}{i}" for n in NAMES]) for i in range(30)]
    columns = ["doc_id", "text", "source", "url", *NAMES]
    return spark.createDataFrame(rows, columns).cache()


@pytest.mark.parametrize("name", ["passages", "mixing", "quality", "urls", "similar"])
def test_extra_columns_stay(spark, docs, name):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {
        "passages": lambda: passages.without_passages(docs),
        "mixing": lambda: mixing.in_order(docs),
        "quality": lambda: quality_llr.judge(docs, labels),
        "urls": lambda: url_filter.judge(docs, [("com/en/", "block"), ("net/en/1", "allow")], trees=1, depth=1),
        "similar": lambda: similar.one_of_each(docs),
    }[name]()
    assert [c for c in got.columns if c in docs.columns] == docs.columns
    rows = got.collect()
    assert len(rows) == 30 or name == "similar"
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
    assert name != "passages" or any(len(r.text) < 30 for r in rows if r.doc_id % 3)


CLASHING = [*NAMES, "id", "ids", "start", "offset", "segment", "sequence_id", "fp", "component_id", "key", "doc", "n", "part", "size", "shards", "law", "position", "phase", "release", "deadline", "query", "score", "runs", "collapsed", "turns", "mask", "least", "copies", "dim", "shard", "embedding_", "place", "links"]


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["packing", "simhash", "planes", "sharding", "interleave", "bpe", "lexical", "periodic"])
def test_clashing_columns_change_no_result(spark, tmp_path, name):
    """Each operator gives the same rows with and without columns of its own inner names."""
    texts = [None, "", " \n", "a b c d e f g", "a b c d e f g", "x y " * 40, "the quick brown fox " * 30, "Ünï 中文 <|endoftext|> ok", "a b c d e f h", "word"]
    rows = [(i if i != 6 else None, t, f"s{i % 2}") for i, t in enumerate(texts)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, source string")
    names = list(dict.fromkeys(CLASHING))
    wide = spark.createDataFrame([(*r, *(f"{n}-{k}" for n in names)) for k, r in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    items = spark.createDataFrame([(1, "a b"), (2, "fox word")], "item_id long, text string")

    def planes(df):
        path = f"{tmp_path}/{len(list(tmp_path.iterdir()))}"
        token_planes.write(df, path, byte, end_id=0)
        return token_planes.read_digests(spark, path, Stage(spark, "test"))

    run = {
        "packing": lambda df: packing.pack_texts(df.coalesce(1), word, end_id=2),
        "simhash": lambda df: simhash.near_duplicates(df),
        "planes": planes,
        "sharding": lambda df: sharding.by_bytes(df, shards=3).select("doc_id", "size", "text_crc32", "shard"),
        "interleave": lambda df: mixing.interleave(df).drop("position"),
        "bpe": lambda df: bpe.encode(df, word, spaced=False, decoded=True),
        "lexical": lambda df: lexical.search(df, items),
        "periodic": lambda df: periodic.find_runs(df),
    }[name]
    assert _rows(run(wide)) == _rows(run(plain))
    run(wide.limit(0)).collect()


def test_empty_tables_give_empty_ones(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (similar.one_of_each(none), passages.without_passages(none), mixing.in_order(none), quality_llr.judge(none, labels)):
        assert got.collect() == []


def test_pipeline_of_an_empty_and_an_all_null_table(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, rows in (("empty", []), ("null", [(None,) * 5] * 3)):
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect() == []


def test_stages_take_very_long_texts(spark, tmp_path):
    """A text of some megabytes, with its copy and its near copy, through every stage after the quality rules."""
    long = " ".join(f"w{i * 7919 % 90_001}" for i in range(300_000))
    rows = [(1, long, "en", "a", len(long)), (2, long, "en", "a", len(long)), (3, long + " end", "en", "b", len(long)), (4, "some other text of its own", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [1, 4]
    left = {r.doc_id: r.text for r in stages.drop_passages(spark, docs, "").collect()}
    assert left[4] == rows[3][1] and all(len(left[i]) < 10 for i in (1, 2, 3))
    assert sorted(r.doc_id for r in stages.mix_sources(spark, docs, "").collect()) == [1, 2, 3, 4]
    packed = stages.pack(spark, docs, "").groupBy("doc_id").agg(F.sum(F.octet_length("ids") / 4).alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(packed) == 4 and all(r.n == r["all"] for r in packed)
