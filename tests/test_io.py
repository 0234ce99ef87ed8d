"""Sources, sinks and streams."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from driftglass.operators.log import replay
from driftglass.sources import files
from driftglass.streaming import replay as stream


def test_listing_and_hashes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.bin", "same"), ("sub/b.bin", "same"), ("c.bin", "diff"), ("d.bin", "longer"), ("e.txt", "same")):
        (tmp_path / name).write_text(text)
    assert files.listing(spark, str(tmp_path), "*.bin").count() == 4
    got = {r.path.rpartition("/")[2]: r.sha256 for r in files.content_hashes(spark, str(tmp_path), "*.bin").collect()}
    assert got["a.bin"] == got["b.bin"] != got["c.bin"] and got["d.bin"] is None


def test_fixed_records(spark, tmp_path):
    (tmp_path / "x.tsq").write_bytes(b"".join(struct.pack("<iHd26x", i, 2 * i, i / 4) for i in range(5)) + b"tail")
    got = files.fixed_records(spark, str(tmp_path), [("size", "i4"), ("kind", "u2"), ("time", "f8")], 40, "*.tsq").orderBy("record").collect()
    assert [tuple(r)[1:] for r in got] == [(i, i, 2 * i, i / 4) for i in range(5)]


def test_lines_append_and_refuse(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    files.append_lines(rows, path)
    files.append_lines(rows.where("k = 2"), path)
    assert files.read_lines(spark, path, "k long, v string").count() == 3
    assert all("null" not in line for f in (tmp_path / "log").glob("*.json") for line in f.read_text().splitlines())
    (tmp_path / "log" / "bad.json").write_text('{"k": broken\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.read_lines(spark, path, "k long, v string").collect()
    kept = files.read_lines(spark, path, "k long, v string", strict=False).collect()
    assert len(kept) == 4 and sum(r._corrupt is not None for r in kept) == 1


def test_checked_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, 2.0)], "k long, share double")
    with pytest.raises(Exception, match="a share lies between 0 and 1"):
        files.write_checked(rows, str(tmp_path / "bad"), {"a share lies between 0 and 1": "share between 0 and 1"})
    files.write_checked(rows.where("k = 1"), str(tmp_path / "good"), {"a share lies between 0 and 1": "share between 0 and 1"})
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert {tuple(r) for r in files.merge_document(old, spark.createDataFrame([("b", "3")], "key string, value string"), "key").collect()} == {("a", "1"), ("b", "3")}


def test_stream_replay_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("us", F.expr("unix_micros(cast(ts as timestamp))")).withColumn("t", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "log")
    for part in (2, 0, 1):  # out of order
        e.where(F.col("event_id") % 3 == part).write.mode("append").parquet(src)
    log = stream.log_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    args = ("user_id", "event_type", "us", "event_id", "signup", "value")
    stream.to_table(stream.replayed(log, *args), str(tmp_path / "state"), str(tmp_path / "c1"), mode="update").awaitTermination()
    want = sorted(map(tuple, replay(e, *args).collect()), key=str)
    assert sorted(map(tuple, stream.latest(spark, str(tmp_path / "state"), "user_id").collect()), key=str) == want
    hours = stream.windowed_rates(log, "t", ["event_type"], "value", late="400 days")
    stream.to_table(hours, str(tmp_path / "rates"), str(tmp_path / "c2"), mode="update").awaitTermination()
    last = spark.read.parquet(str(tmp_path / "rates")).groupBy("start", "event_type").agg(F.max_by("n", "version").alias("n"))
    assert last.agg(F.sum("n")).first()[0] == e.count()


def test_versions(spark, tmp_path):
    from driftglass.sources import versions

    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert versions.table_hash(rows) == versions.table_hash(rows.orderBy("k", ascending=False)) != versions.table_hash(rows.where("k = 1"))
    root, settings = str(tmp_path / "t"), {"enter": 3.0, "cap": None}
    assert versions.write_version(rows, root, settings) == versions.version_of({"enter": 3.0})
    versions.write_version(rows.limit(0), root, settings)
    assert versions.read_version(spark, root, settings).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        versions.read_version(spark, root, {"enter": 2.0})
