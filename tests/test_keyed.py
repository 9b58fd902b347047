"""Keyed tables: bytes follow the batch, runs that fail or repeat leave whole versions, and differences read what differs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fieldlens.sources import keyed
from fieldlens.streaming import intake

SCHEMA = "k long, v string, seq long"


def rows(df):
    return sorted((r["k"], r["v"]) for r in df.select("k", "v").collect())


def written(root, version):
    return sorted(d for d in os.listdir(f"{root}/data/version={version}") if d.startswith("bucket="))


def test_a_batch_writes_the_buckets_that_it_touches(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    base = spark.range(2000).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).cast("long").alias("seq"))
    assert keyed.merge(base, root, ["k"], "seq", buckets=32) == 0 and len(written(root, 0)) == 32
    batch = spark.createDataFrame([(7, "old", 1), (7, "new", 2), (9999, "x", 1)], SCHEMA)
    assert keyed.merge(batch, root, ["k"], "seq") == 1 and 1 <= len(written(root, 1)) <= 2
    now = dict(rows(keyed.read(spark, root, SCHEMA)))
    assert now[7] == "new" and now[9999] == "x" and len(now) == 2001
    assert len(rows(keyed.read(spark, root, SCHEMA, 0))) == 2000
    changed = keyed.changed_buckets(spark, root, 0, 1)
    assert 1 <= len(changed) <= 2
    found = keyed.difference(spark, root, SCHEMA, ["k"], 0, 1)
    assert sorted(map(tuple, found.collect())) == [(7, "changed"), (9999, "added")] and 0 < len(found.inputFiles()) <= 4


def test_repeated_and_broken_runs(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA)
    keyed.merge(one, root, ["k"], "seq", 0, buckets=4)
    two = spark.createDataFrame([(2, "c", 2)], SCHEMA)
    # files of a version without a manifest: the run failed before its end
    one.withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{root}/data/version=1")
    assert rows(keyed.read(spark, root, SCHEMA)) == [(1, "a"), (2, "b")]
    for _ in range(2):
        assert keyed.merge(two, root, ["k"], "seq", 1) == 1
    assert rows(keyed.read(spark, root, SCHEMA)) == [(1, "a"), (2, "c")]
    with pytest.raises(ValueError):
        keyed.merge(two, root, ["k"], "seq", 5)
    for k in range(3, 8):
        keyed.merge(spark.createDataFrame([(k, "n", k)], SCHEMA), root, ["k"], "seq", versions_kept=2)
    assert len(keyed.versions(spark, root)) == 2 and len(keyed.read(spark, root, SCHEMA).collect()) == 7
    current = {(r["at"], r["bucket"]) for v in keyed.versions(spark, root) for r in keyed.manifest(spark, root, v).collect()}
    there = {(int(v.split("=")[1]), int(b.split("=")[1])) for v in os.listdir(f"{root}/data") for b in os.listdir(f"{root}/data/{v}") if b.startswith("bucket=")}
    assert there <= current
    assert rows(keyed.read(spark, tempfile.mkdtemp(prefix="spark-"), SCHEMA)) == []


def test_feed_of_three_batches(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    for k, batch in enumerate([[(1, "a", 1), (2, "b", 1)], [(2, "c", 2)], [(3, "d", 3)]]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(root + "/in")
        stream = spark.readStream.schema(SCHEMA).parquet(root + "/in")
        intake.upsert_feed(stream, root + "/t", ["k"], "seq", root + "/c", buckets=4).awaitTermination(60)
        assert keyed.versions(spark, root + "/t")[-1] == k
    assert rows(keyed.read(spark, root + "/t", SCHEMA)) == [(1, "a"), (2, "c"), (3, "d")]
