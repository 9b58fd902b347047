"""Places and running values of hot groups, and the log of evidence."""

import datetime

from pyspark.sql import functions as F

from fieldlens.operators import lookup, rank, report, resolve, season
from fieldlens.functions import text


def test_a_hot_group_is_dealt_evenly(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 40_000).alias("o"), F.rand(3).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = rank.in_order(rows, ["g"], [F.col("o")]).groupBy("_p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["count"] for r in parts)
    assert len(sizes) > 2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_running_values_equal_a_window(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("g"), (F.col("id") * 31 % 5000).alias("o"), F.when(F.col("id") % 4 > 0, F.col("id") % 17).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for current in (True, False):
            got = rank.running(rows, ["g"], [F.col("o")], {k: (k, F.col("v")) for k in ("sum", "min", "max", "last")}, current=current).collect()
            seen = {}
            for r in sorted(got, key=lambda r: (str(r["g"]), r["o"])):
                values = seen.setdefault(r["g"], [])
                if current and r["v"] is not None:
                    values.append(r["v"])
                want = (sum(values), min(values), max(values), values[-1]) if values else (None,) * 4
                assert (r["sum"], r["min"], r["max"], r["last"]) == want
                if not current and r["v"] is not None:
                    values.append(r["v"])
            assert len(got) == 5000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rank.running(rows.filter("false"), ["g"], [F.col("o")], {"s": ("sum", F.col("v"))}).count() == 0


def test_running_harvest_of_one_plant(spark):
    rows = spark.range(3000).select(F.lit("p").alias("plant"), F.col("id").alias("day"), F.when(F.col("id") > 9, 1).otherwise(0).alias("grams"))
    out = season.running_harvest(rows, "plant", "day", "grams")
    assert out.filter("cumulative <> greatest(day - 9, 0) OR first_harvest <> 10").count() == 0 and out.count() == 3000


def test_names_told_before(spark):
    day = lambda n: datetime.date(2026, 3, n)
    known = spark.createDataFrame([(1, day(1), 9, "late row"), (1, day(2), 3, "early row"), (1, day(3), 10, "last")], "number long, run_date date, row_index long, v string")
    rows = spark.createDataFrame([(1, day(1)), (1, day(3)), (1, day(5)), (2, day(5)), (None, day(5))], "number long, run_date date")
    got = {(r["number"], r["run_date"].day): r["told"] for r in lookup.told_before(rows, known, "number", "v", "told").collect()}
    assert got == {(1, 1): None, (1, 3): "late row", (1, 5): "last", (2, 5): None, (None, 5): None}


ROW = "row_index long, run_date date, asset string, label string, pot_tag string, packet_tag string, notes string, caption string, ocr_excerpt string, variety_name string, species_common_name string"


def resolved(spark, rows, series, fixed=(), base=(), over=(), **params):
    table = lambda data, schema: spark.createDataFrame(list(data), schema)
    overrides = table(over, "run_date date, row_index long, asset string, confirmed_subject string, confirmed_class string, notes string, reviewed string")
    out = resolve.resolve_identities(
        table(rows, ROW), table(series, "series_number long, series_name string, row_index long"), table(fixed, "subject_id string, series_number long, row_index long"),
        table(base, "subject_id string, baseline_name string, row_index long"), overrides, resolve.Params(**params),
    )
    return out, overrides


def test_the_last_entered_number_names_a_baseline(spark):
    day = datetime.date(2026, 3, 1)
    rows = [(1, day, "a", "tomato", "5T", None, "", "", "", None, None)]
    out, _ = resolved(spark, rows, [(9, "Glacier", 1), (2, "glacier!", 2), (9, "Glacier", 3)], base=[("5T", "Glacier", 1)])
    assert out.first()["class_number"] == 2  # 9 was entered first, though given again last


def test_warnings_do_not_stop_a_run(spark):
    day = datetime.date(2026, 3, 1)
    rows = [(i, day, f"a{i}", "tomato", f"{i}T", None, f"packet_tag={3 if i < 3 else 4}", "", "", n, None) for i, n in ((1, "Sasha"), (2, "Taxi"), (3, "It's"))]
    out, over = resolved(spark, rows, [(3, "Taxi", 1), (4, "It's", 2)], name_fallback=True, expected=3)
    messages = resolve.run_messages(out, over, 3)
    got = {(r["severity"], r["code"]): r["text"] for r in messages.collect()}
    assert got == {
        ("warning", "packet_name"): "row 1: packet_number=3 maps to 'Taxi' but row variety is 'Sasha'",
        ("warning", "conflicting_class_names"): "packet 3: conflicting varieties ['Sasha', 'Taxi']",
    }
    assert [tuple(r)[1:] for r in resolve.gate(messages, out).collect()] == [(0, 2, True)]


def test_duplicates_are_errors_that_list_their_rows(spark):
    day = datetime.date(2026, 3, 1)
    rows = [(i, day, f"a{i}", "tomato", "1T", None, "", "", "", n, None) for i, n in ((7, "It's"), (8, "Taxi"))] + [(9, day, "a9", "tomato", None, None, "", "", "", "Taxi", None)]
    over = [(day, 9, "a9", None, None, "exclude_row=1; missing_pots: 2T, 3", "yes"), (day, 8, "a8", None, None, "missing 9", "no")]
    out, over = resolved(spark, rows, [], over=over, name_fallback=True, expected=3)
    got = sorted((r["severity"], r["code"], r["text"]) for r in resolve.run_messages(out, over, 3).collect())
    assert got == [
        ("error", "conflicting_names", "pot 1T: conflicting varieties [\"It's\", 'Taxi']"),
        ("error", "duplicate_subject", "pot 1T: duplicate rows [7, 8]"),
        ("warning", "declared_missing", "declared missing pots via manual row override: 2T, 3T"),
        ("warning", "excluded_row", "row 9: excluded by manual row override"),
        ("warning", "other_rows", "run contains non-tomato/unknown rows: tomato_candidates=2 total_rows=3"),
    ]
    short = resolve.run_messages(out, over, 3, most_listed=1).filter("code = 'duplicate_subject'").first()["text"]
    assert short == "pot 1T: duplicate rows 2"


def test_texts_of_boxes_and_messages(spark):
    said = ["varietal 12", "Varietal no 7", "variet number 5", "12 variet tag", "pot 1234T", "12345 t pot", "tag for pot 05 t", "5 T in a POT", "5t", "", None, "variety 5", "varietal no. 4"]
    got = [tuple(r["k"]) for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i").select(text.annotation_kind(F.col("s")).alias("k")).collect()]
    assert got == [("varietal", "12"), ("varietal", "7"), ("varietal", "5"), ("varietal", "12"), ("other", None), ("other", None), ("pot", "5T"), ("pot", "5T"), ("other", None), ("unlabeled", None), ("unlabeled", None), ("other", None), ("other", None)]
    messages = spark.createDataFrame([("row 3: pot 5t: x",), ("pot 05T",), ("lot 12T arrived",), ("pot 0T",), (None,)], "m string")
    assert [tuple(r) for r in report.subjects_in_messages(messages, "m").collect()] == [("5T", 2)]
