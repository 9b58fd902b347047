"""Cases of ranks, seeds, phases, feeds and text rules that the registered queries do not meet."""

import datetime
import os
import tempfile

from pyspark.sql import functions as F

from fieldlens.functions import ids, text
from fieldlens.operators import boxes, merge, quality, rank
from fieldlens.sources import tables
from fieldlens.streaming import intake


def test_ranks_are_the_same_whatever_is_selected(spark):
    n = 30_000  # more than the sample of the bounds
    rows = spark.range(n).select(F.col("id").alias("a"), (F.col("id") * 7919 % n).alias("b"), F.lit("x" * 50).alias("wide"))
    ranked = rank.global_rank(rows, [F.col("b")])
    assert ranked.filter("rank <> b + 1").count() == 0
    assert ranked.select("rank").distinct().count() == n and ranked.select("a", "rank").agg(F.max("rank")).first()[0] == n


def test_positions_in_a_hot_group(spark):
    rows = spark.range(4000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("g"))
    got = {(r["g"], r["i"]): r["p"] for r in rank.positions(rows, ["g"], [F.col("i")], "p").collect()}
    seen = {}
    for g, i in sorted(got, key=lambda k: (str(k[0]), k[1])):
        seen[g] = seen.get(g, 0) + 1
        assert got[g, i] == seen[g]
    assert rank.positions(rows.filter("false"), ["g"], [F.col("i")], "p").count() == 0


def test_expected_class_beats_a_nearer_box(spark):
    box = "photo string, ord int, kind string, value string, x double, y double, w double, h double"
    rows = [("a", 0, "pot", "1T", 0.1, 0.1, 0.1, 0.1), ("a", 1, "pot", "1T", 0.1, 0.1, 0.02, 0.02), ("a", 2, "varietal", "9", 0.12, 0.1, 0.1, 0.1), ("a", 3, "varietal", "5", 0.5, 0.5, 0.1, 0.1), ("a", 4, "varietal", "9", 0.121, 0.1, 0.1, 0.1), ("a", 5, "other", None, 0.0, 0.0, 0.1, 0.1)]
    expected = spark.createDataFrame([("1T", 5)], "subject_id string, expected long")
    got = [tuple(r) for r in boxes.resolved_seeds(spark.createDataFrame(rows, box), "photo", expected).select("pair_index", "subject_ord", "class_ord", "evidence_type").orderBy("pair_index").collect()]
    assert got == [(1, 0, 3, "pot_plus_varietal_match"), (2, None, 2, "varietal_only")]


def test_configured_end_holds_without_overlap(spark):
    day = datetime.date
    phases = spark.createDataFrame([("a", day(2026, 1, 1), day(2026, 2, 1), 1, None), ("b", day(2026, 3, 1), day(2026, 4, 1), 2, None)], "phase_id string, start_date date, end_date date, priority int, explicit_end boolean")
    runs = spark.createDataFrame([(day(2026, 2, 20),)], "run_date date")
    assert {r["phase_id"]: r["effective_end"] for r in quality.effective_end(phases, runs).collect()} == {"a": day(2026, 2, 1), "b": day(2026, 4, 1)}


def test_text_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(ids.excludes_row(F.lit("exclude-row=1"))) and get(ids.excludes_row(F.lit("Duplicate of row 3"))) and not get(ids.excludes_row(F.lit("excluded")))
    assert get(ids.declared_missing(F.lit("missing pots: 21T, a3; missing-pot=04t"))) == ["21T", "3T", "4T"]
    keys = ["early_girl"]
    assert [get(text.is_subject_of_interest(F.lit(c), keys)) for c in ("Kale | non_tomato_03 | unknown", "Early Girl | p1 | x", "Tomatoes", "", "EARLY girl")] == [False, True, True, False, True]
    assert get(text.classify_text(F.lit("a Stupice plant"))["label"]) == "tomato" and get(text.classify_text(F.lit("kale, tomato"))["label"]) == "non_tomato"
    assert get(text.variety_name(F.lit("unknown"), F.lit(None).cast("string"), F.lit("Tomato | x"))) == "Tomato"
    assert get(text.saved_at(F.lit("bad"), F.lit("2026-03-01T10:00:00+02:00"))) == datetime.datetime(2026, 3, 1, 8)


def test_sources_and_sinks(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(root + "/j/deep")
    for name, body in (("a.json", '{"v": 1}'), ("deep/b.json", "{broken")):
        with open(f"{root}/j/{name}", "w") as f:
            f.write(body)
    tree = tables.read_json_tree(spark, root + "/j", "v int")
    assert tree.count() == 2 and [r["source_file"].rsplit("/", 1)[1] for r in tables.unreadable(tree).collect()] == ["b.json"]
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    tables.write_fields(df, root + "/f", ["a", "missing", "b"])
    assert spark.read.parquet(root + "/f").columns == ["a", "missing", "b"]
    tables.write_report(df, root + "/r")
    for _ in range(2):
        tables.append_history(df, root + "/h")
    assert spark.read.json(root + "/r").count() == 1 and spark.read.parquet(root + "/h").count() == 2
    lines = spark.createDataFrame([("k", 0, "pot", 0.1, 0.2, 0.2, 0.4)], "task_key string, ord int, label string, x double, y double, w double, h double")
    tables.write_yolo(lines, root + "/y", ["pot"])
    assert spark.read.text(root + "/y").count() == 1


def test_daily_counts(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    e = spark.createDataFrame([("2024-01-01 01:00:00", "x"), ("2024-01-01 09:00:00", "x"), ("2024-01-09 00:00:00", "y")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    e.coalesce(1).write.parquet(root + "/in")
    s = spark.readStream.schema("ts timestamp, kind string").parquet(root + "/in").withWatermark("ts", "1 day")
    q = intake.daily_counts(s, "ts", "kind").writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", root + "/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["kind"], r["n"]) for r in spark.table("days").collect()) == [("x", 2), ("y", 1)]


def test_photos_without_use(spark):
    photo = "array<struct<row_index:long,asset:string,exclude_from_training:boolean,boxes:array<struct<x:double>>>>"
    schema = f"path string, version string, saved_at string, capture_date string, row_index long, asset string, boxes array<struct<x:double>>, photos {photo}"
    one = [(0.5,)]
    many = [None, (None, "a", True, one), (4, "", None, one), (5, "b", False, []), (6, "c", False, None), (None, "d", None, one)]
    rows = [("p", "v", "t", "2026-01-01", None, None, None, many), ("q", "v", "t", " ", 1, "a", one, None), ("r", "v", "t", "d", None, None, None, None), ("s", "v", "t", "d", 2, "a", one, many)]
    use = boxes.usability(boxes.photo_rows(spark.createDataFrame(rows, schema)))
    got = {(r["path"], r["position"]): (r["row_index"], r["skip"]) for r in use.collect()}
    want = {0: (1, "no_asset"), 1: (2, "excluded"), 2: (4, "no_asset"), 3: (5, "no_boxes"), 4: (6, "no_boxes"), 5: (6, None)}
    assert got == {("p", k): v for k, v in want.items()} | {("q", 0): (1, "no_date"), ("s", 0): (2, None)}
    assert tuple(boxes.usability_counts(use).first()) == (8, 2, 6, 1)
    assert tuple(boxes.usability_counts(use.filter("false")).first()) == (0, 0, 0, 0)


def test_anchors_of_runs(spark):
    schema = "run_date string, row_index long, confirmed_subject string, notes string, reviewed string"
    rows = [("d1", 1, "01t", None, "yes"), ("d1", 2, "1T", "missing_pots: 21T", " TRUE "), ("d1", 3, "2T", "exclude_row=1", None), ("d2", 1, None, "chosen", "yes"), ("d2", 2, "5T", "", "yes"), (None, 1, "9T", None, "yes")]
    o = spark.createDataFrame(rows, schema)
    runs = lambda *a: sorted(tuple(r) for r in quality.anchor_runs(o, *a).collect())
    assert runs() == [("d1", 3, 2, 1), ("d2", 2, 2, 1)]
    assert runs(spark.createDataFrame([("d2", 1), ("d2", 1), ("d2", 9)], "run_date string, row_index long")) == [("d1", 3, 2, 1), ("d2", 1, 1, 0)]
    marks = lambda run, s, gone, chosen: tuple(quality.anchor_marks(o, run, s, gone, chosen, "chosen").first())
    assert marks("d1", "21T", 3, 1) == (True, False, True, False)
    assert marks("d2", "5T", 1, 1) == (False, True, False, True)
    assert marks("d9", "5T", 1, 1) == (False, False, False, False)


def test_refresh_with_short_batch(spark):
    triage = spark.createDataFrame([("1T",), ("2T",), (None,), ("2T",)], "k string")
    batch = spark.createDataFrame([("1T",), (None,)], "k string")
    got = lambda b, n: sorted(tuple(r) for r in merge.refresh_problems(triage, b, "k", n).collect())
    assert got(batch, 2) == [("missing_in_batch", "2T"), ("missing_in_batch", "2T")]
    assert got(batch.filter("false"), 3)[0] == ("batch_size", "0")
