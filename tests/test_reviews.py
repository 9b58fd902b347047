"""Cases of the review operators that the registered queries do not meet."""

import datetime

from pyspark.sql import functions as F

from fieldlens.operators import report, review, similarity

DAY = datetime.date(2026, 3, 27)
REVIEW = "run_date date, row_index long, asset string, photo_url string, suggested_subject string, confirmed_subject string, suggested_name string, confirmed_name string, verdict string, do_not_use string, notes string"
QUEUE = "run_date date, row_index long, asset string, photo_url string, subject_id string, variety_name string"
NAMES, CLASSES = "series_name string, series_number long, row_index long", "subject_id string, series_number long, row_index long"


def canonical(spark, said, queued):
    names = spark.createDataFrame([("Sun Gold", 3, 1), ("sun  gold", 4, 2), ("", 9, 3)], NAMES)
    classes = spark.createDataFrame([("5T", 7, 1)], CLASSES)
    labeled = spark.createDataFrame([], "run_date date, row_index long, asset string, photo_url string")
    return review.canonical_reviews(spark.createDataFrame(said, REVIEW), spark.createDataFrame(queued, QUEUE), labeled, names, classes).collect()


def test_empty_queue_takes_the_reviews_keys_and_cross_fills(spark):
    (row,) = canonical(spark, [(DAY, 1, "a", None, "4", "", "", "SUN-GOLD", "Drop", "", "x; x")], [])
    assert (row.suggested_subject, row.confirmed_subject, row.suggested_class, row.confirmed_class, row.exclude_row) == ("4T", "4T", 4, 4, True)
    assert row.photo_url is None and row.notes == "x; x; phase2_start=1; phase2_micro_env=outdoor_sun; exclude_row=1"


def test_map_moves_a_class_unless_it_is_kept(spark):
    said = [(DAY, 1, "a", "", "5t", "5T", "Sun Gold", "Sun Gold", None, "", "varietal_lock=1")]
    (row,) = canonical(spark, said, [(DAY, 1, "a", "q", "9T", "nothing")])
    assert (row.suggested_class, row.confirmed_class, row.photo_url) == (7, 4, "q")
    assert "suggested_varietal_aligned_to_pot_map=1" in row.notes and "confirmed_varietal" not in row.notes


def test_nothing_gives_nothing(spark):
    assert canonical(spark, [], []) == []
    rows = spark.createDataFrame([], "run_date date, confirmed_subject string, exclude_row boolean")
    assert review.subject_checks(rows, 3).collect() == []


def test_subjects_of_excluded_rows_are_missing(spark):
    rows = spark.createDataFrame([(DAY, "1T", False), (DAY, "1T", False), (DAY, "2T", True), (DAY, None, False)], "run_date date, confirmed_subject string, exclude_row boolean")
    assert sorted((r.code, r.subject_number) for r in review.subject_checks(rows, 3).collect()) == [("duplicate", 1), ("missing", 2), ("missing", 3)]


def test_other_species_get_caption_and_note(spark):
    rows = spark.createDataFrame([(1, "", "seen", "", "fresh basil leaf"), (2, "mine", "", "", ""), (3, None, None, None, None)], "row_index long, caption string, notes string, crop string, whole string")
    a, b, c = review.two_tier_labels(rows, "crop", "whole").orderBy("row_index").collect()
    assert a.label == "non_tomato" and a.caption.endswith(" | non_tomato_01 | unknown") and a.notes == "seen; OCR: fresh basil leaf"
    assert (b.label, b.caption, b.notes, b.ocr_excerpt) == ("unknown", "mine", "", None)
    assert c.label == "unknown" and c.caption is None


def test_summaries_of_no_rows(spark):
    none = spark.createDataFrame([], "focus double, coverage double, inner_spill double, neighbor_spill double, growth double, next_step string")
    assert tuple(report.metric_summary(none).first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)
    assert report.ingest_summary(spark.createDataFrame([("pending",)], "status string")).first().advice == "annotate"
    assert report.top_category(spark.createDataFrame([("b",), ("a",), (None,)], "v string"), "v").first().value == "a"


def test_one_template_leaves_its_score_as_margin(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "row_key long, v array<double>")
    known = spark.createDataFrame([(3, [1.0, 0.0])], "s long, template array<double>")
    voted = spark.createDataFrame([], "row_key long, number long, votes long")
    (row,) = similarity.hard_rows(rows, rows.filter(F.col("row_key") == 2), "v", known, "s", voted, 8).collect()
    assert (row.row_key, row.number, row.tier, row.margin, row.top3) == (1, 3, "needs_manual", 1.0, "3")


def test_blocks_of_templates_give_the_same_matches(spark):
    rows = spark.range(40).select(F.col("id").alias("k"), F.array(*(F.sin(F.col("id") * n + n) for n in (1, 2, 3))).alias("v"))
    known = spark.range(25).select(F.col("id").alias("s"), similarity.unit(F.array(*(F.cos(F.col("id") * n - n) for n in (1, 2, 3)))).alias("template"))
    twice = rows.unionByName(rows.filter("k < 3"))
    one, many = (sorted(map(tuple, similarity.matches(twice, "v", known, "s", "k", 3, most).collect())) for most in (100, 4))
    assert one == many and len(one) == 129
