"""Exact medians of hot groups, rates of runs of usual size, and faults of an audit."""

import datetime

from pyspark.sql import functions as F

from fieldlens.operators import report, resolve
from tests.test_order import resolved


def test_medians_by_order_equal_medians_by_buffer(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("g"), F.when(F.col("id") % 5 > 0, (F.col("id") * 7919 % 101).cast("double")).alias("v"), F.lit(None).cast("double").alias("w"))
    rows = rows.unionByName(spark.createDataFrame([("one", 4.0, 2.0), ("two", 4.0, 1.0), ("two", 5.0, 2.0)], "g string, v double, w double"))
    want = {tuple(r) for r in report.medians(rows, "g", ["v", "w"]).collect()}
    assert {tuple(r) for r in report.medians(rows, "g", ["v", "w"], most=1).collect()} == want and ("two", 4.5, 1.5) in want
    assert report.medians(rows.filter("false"), "g", ["v"]).count() == 0


def test_runs_of_usual_size_have_extra_rows(spark):
    rows = [(n * 100 + i, datetime.date(2026, 3, n), f"a{n}-{i}", "tomato", None, None, "", "", "", None, None) for n, size in ((1, 34), (2, 35)) for i in range(size)]
    out, _ = resolved(spark, rows, [], usual_sizes=(30, 34))
    rates = {r["run_date"].day: r["sequential_rate"] for r in report.mapping_rates(out, ("sequence_inference",)).collect()}
    assert out.filter("dropped = 'extra'").count() == 2 and rates == {1: round(32 / 34, 4), 2: 1.0}
    texts = [r["text"] for r in resolve.run_messages(out, spark.createDataFrame([], "run_date date, reviewed string, notes string"), 32).filter("code = 'extra_row'").orderBy("text").collect()]
    assert texts == [f"row {i}: skipped extra row beyond expected_pots=32 with no explicit pot_id" for i in (132, 133)]


def test_faults_of_an_audit(spark):
    manual = spark.createDataFrame([("a", ["1T"], [3]), ("b", ["2T"], [4]), ("c", [], [])], "photo string, subjects array<string>, classes array<long>")
    predicted = spark.createDataFrame([("a", "1T", 3), ("b", "9T", 0)], "photo string, subject_id string, class_number long")
    pairs = spark.createDataFrame(
        [("a", "1T", 3, 3, ""), ("b", "2T", 5, 4, "pot_varietal_conflict"), ("b", "7T", 1, None, "missing_varietal_pair"), ("b", None, None, 8, "orphan_varietal_without_pot"), ("c", "5T", 5, 5, "pot_varietal_conflict")],
        "photo string, subject_id string, expected long, class_number long, review_reason string",
    )
    got = sorted(r["pattern"] for r in report.failures(manual, predicted, pairs, "photo").collect())
    assert got == ["conflict: pot 2T expected 5 labeled 4", "missing_varietal_for_pot: 7T", "orphan_varietal: 8", "pipeline_pot_not_in_manual_set: 9T"]
    audit = report.presence_audit(manual, predicted, pairs, "photo").first()
    assert (audit["joined"], audit["exact_rate"], audit["both_rate"]) == (2, 0.5, 0.5)
