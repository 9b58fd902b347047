"""Sources, sinks, streams and the expressions that no registered query covers."""

import tempfile

from pyspark.sql import functions as F

from fieldlens.functions import ids, text
from fieldlens.sources import tables
from fieldlens.streaming import intake


def scratch():
    return tempfile.mkdtemp(prefix="spark-")


def test_csv_with_bom_and_quoted_lines(spark):
    path = scratch() + "/a.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write('﻿id,name\n1,"a ""b""\nc"\n2,\n')
    got = [(r["id"], r["name"]) for r in tables.read_csv(spark, path, "id int, name string").collect()]
    assert got == [(1, 'a "b"\nc'), (2, None)]


def test_run_replacement_is_idempotent(spark):
    path = scratch() + "/t"
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int")
    tables.replace_run(df, path)
    for _ in range(2):
        tables.replace_run(spark.createDataFrame([("r2", 5)], "run_id string, v int"), path)
    assert sorted((r["run_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("r1", 1), ("r2", 5)]


def test_write_if_changed(spark):
    root = scratch()
    df = spark.createDataFrame([(1, "t1")], "v int, generated_at string")
    assert tables.write_if_changed(df, root + "/t", root + "/s")
    assert not tables.write_if_changed(df.withColumn("generated_at", F.lit("t2")), root + "/t", root + "/s")
    assert tables.write_if_changed(df.withColumn("v", F.lit(2)), root + "/t", root + "/s")


def test_snapshot_guard(spark):
    df = spark.range(3)
    manifest = tables.snapshot({"a": df}, scratch(), "v1", "2026-01-01")
    assert tables.changed_without_version({"a": df}, manifest).count() == 0
    assert tables.changed_without_version({"a": spark.range(4)}, manifest).count() == 1


def test_yolo_lines(spark):
    b = spark.createDataFrame([("k", 0, "pot", 0.1, 0.2, 0.2, 0.4), ("k", 1, "none", 0.0, 0.0, 0.1, 0.1)], "task_key string, ord int, label string, x double, y double, w double, h double")
    assert [r["value"] for r in tables.yolo_lines(b, ["leaf", "pot"]).collect()] == ["1 0.200000 0.400000 0.200000 0.400000"]


def test_streams(spark):
    root = scratch()
    e = spark.createDataFrame([("a", "2024-01-01 01:00:00", "x"), ("a", "2024-01-01 01:00:00", "x"), ("b", "2024-01-01 02:00:00", "x"), ("c", "2024-01-09 00:00:00", "y")], "asset string, ts string, kind string")
    e.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(root + "/in")
    s = intake.asset_stream(spark, root + "/in", "asset string, ts timestamp, kind string", "ts", "asset")
    q = s.writeStream.format("memory").queryName("assets").option("checkpointLocation", root + "/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("SELECT count(*) FROM assets").first()[0] == 3


def test_ids_and_notes(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert [get(ids.subject_id(F.lit(t))) for t in ("007t", " 12 ", "0T", "1234", "x1", "")] == ["7T", "12T", None, None, None, None]
    assert get(ids.subject_id(F.lit("12"), "tagged")) is None and get(ids.subject_id(F.lit("1234"), "loose")) == "1234T"
    assert get(ids.declared_missing(F.lit("exclude_row=1; missing_pots: 21T, 3; missing 4T"))) == ["21T", "3T", "4T"]
    assert get(ids.excludes_row(F.lit("exclude_row=0"))) and not get(ids.excludes_row(F.lit("fine")))
    assert get(ids.number_candidates(F.lit("5 0 005 1234 99"))) == [5, 99]
    assert get(text.alias(F.lit(" Bes  Yellow-Latvian "))) == "Iles Yellow Latvian"
    kinds = {"Varietal No 07": ("varietal", "07"), "pot 012 T": ("pot", "12T"), "5 varietal tag": ("varietal", "5"), "": ("unlabeled", None), "leaf": ("other", None)}
    assert {k: tuple(get(text.annotation_kind(F.lit(k)))) for k in kinds} == kinds
    assert get(text.capture_date(F.lit(None).cast("string"), F.lit("2026-03-01T23:59:00-08:00"), F.lit("x"))).isoformat() == "2026-03-01"
