"""Every kind of document is written and read back."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from driftglass.operators import runs
from driftglass.sources import documents as D


def pairs(df):
    return {r.key: r.value for r in df.collect()}


def test_settings_keep_unknown_keys(spark, tmp_path):
    path, rows = str(tmp_path / "geometry"), lambda d: spark.createDataFrame(list(d.items()), "key string, value string")
    assert pairs(D.read_document(spark, path)) == {}
    assert D.update_document(spark, path, rows({"pitch": "2", "note": "by hand"})) == 1
    assert D.update_document(spark, path, rows({"pitch": "3", "map": None})) == 2
    assert pairs(D.read_document(spark, path)) == {"pitch": "3", "note": "by hand", "map": None}
    with pytest.raises(ValueError, match="twice"):
        D.update_document(spark, path, rows({"a": "1"}).union(rows({"a": "2"})))


def test_labels_and_clocks(spark):
    data = [("a; b ;c", "2026-01-02 03:04:05", "/x/rat-260102-030410"), (" ; ", None, "/x/rat-260102-030410/"), (None, "2026-01-02 03:04:05", "/x/plain"), ("a;;b", "2026-01-02 04:04:05", "/x/rat-260102-030405"), ("one", "2026-01-02 03:04:05", "/x/rat-269902-030405")]
    rows = spark.createDataFrame(data, "t string, c string, p string")
    got = [tuple(r) for r in rows.select(D.labels_of(F.col("t")), D.clock_disagrees(F.col("c").cast("timestamp"), F.col("p"))).collect()]
    assert got == [(["a", "b", "c"], False), (None, None), (None, None), (["a", "", "b"], True), (["one"], None)]


def test_mask_files(spark, tmp_path):
    spans = spark.createDataFrame([("u", 0, 5), ("u", 9, 12)], "unit string, start long, stop long")
    gate = spark.createDataFrame([("u", 0.9, 0.5), ("v", 1.0, 0.5)], "unit string, kept double, least double")
    told = spark.createDataFrame([("u", '{"rule":1}'), ("v", "{}")], "unit string, settings string")
    D.write_masks(str(tmp_path / "ok"), spans, gate, told, ["unit"])
    back = D.read_masks(spark, str(tmp_path / "ok"))
    assert [sorted(map(tuple, df.collect())) for df in back] == [sorted(map(tuple, df.collect())) for df in (spans, gate, told)]
    empty = spark.createDataFrame([("u", 5, 5)], spans.schema)
    bad = {
        "without a gate": (spans, gate.where("unit = 'v'"), told), "one provenance": (spans, gate, told.where("unit = 'u'")), "two gates": (spans, gate.union(gate), told),
        "is empty": (empty, gate, told), "between 0 and 1": (spans, gate.withColumn("kept", F.lit(2.0)), told), "settings are JSON": (spans, gate, told.withColumn("settings", F.lit("{x"))),
    }
    for k, (what, parts) in enumerate(bad.items()):
        with pytest.raises(Exception, match=what):
            D.write_masks(str(tmp_path / f"bad{k}"), *parts, ["unit"])


def test_hashed_tables(spark, tmp_path):
    root, rows = str(tmp_path), spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    name = D.write_hashed(rows, root)
    assert D.write_hashed(rows.orderBy(F.desc("k")), root) == name != D.write_hashed(rows.where("k = 1"), root)
    assert sorted(map(tuple, D.read_hashed(spark, root, name).collect())) == [(1, "a"), (2, None)]
    rows.where("k = 2").write.mode("overwrite").parquet(f"{root}/hash={name}")
    with pytest.raises(ValueError, match="changed"):
        D.read_hashed(spark, root, name)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b|c", 0.123456, None), ("a", None, 3)], "name string, share double, n long")
    told = "| name | share | n |\n| --- | --- | --- |\n| a | - | 3 |\n| b\\|c | 0.1235 | - |\n"
    assert D.markdown_table(rows, ["name"]) == told
    D.write_report(str(tmp_path / "r"), {"summary": (rows, ["name"]), "again": (rows.limit(1), ["name"])})
    assert spark.read.parquet(str(tmp_path / "r/summary")).count() == 2
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "r/report")).collect())
    assert text.startswith("## summary\n\n" + told) and "## again" in text
    with pytest.raises(ValueError, match="over 1000"):
        D.markdown_table(spark.range(1001), ["id"])
    aliases = spark.createDataFrame([("x", "y", 1), ("y", "y", 2)], "alias string, name string, n long")
    D.write_aliases(str(tmp_path / "a"), aliases)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    for more in (("x", "z", 1), ("z", "x", 1)):
        with pytest.raises(ValueError, match="no one name"):
            D.write_aliases(str(tmp_path / "b"), aliases.union(spark.createDataFrame([more], aliases.schema)))


def test_union_length_by_blocks(spark):
    import random

    r = random.Random(3)
    data = [(k, a, a + r.randrange(0, 60)) for k in "ab" for a in (r.randrange(-300, 900) for _ in range(60))] + [("c", 5, 5), ("d", -1000, 1000)]
    rows = spark.createDataFrame(data, "k string, start long, stop long")
    want = {k: len({t for q, a, b in data if q == k for t in range(a, b)}) for k in "abcd"}
    for block in (None, 7, 64, 5000):
        assert {q.k: q.length for q in runs.union_length(rows, ["k"], block).collect()} == want
    halves = rows.select("k", (F.col("start") / 2).alias("start"), (F.col("stop") / 2).alias("stop"))
    assert {q.k: q.length for q in runs.union_length(halves, ["k"], 3.0).collect()} == {k: n / 2 for k, n in want.items()}
