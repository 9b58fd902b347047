"""Counters, profiles, audits and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids
from ..sources.shared import stored
from .rank import positions


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def medians(rows: DataFrame, group: str, columns: list[str], most: int = 1_000_000) -> DataFrame:
    """(group, median_<column>...): exact medians of the values that are there.

    A group of up to `most` rows is one task's buffer; the values of larger ones are numbered in order by all tasks, and the
    one or two in the middle are looked up.
    """
    named = rows.select(F.col(group).alias("_group"), *columns)
    large = stored(named.groupBy("_group").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(F.col("_group").alias("_large")), "large-groups")
    same = F.col("_group").eqNullSafe(F.col("_large"))
    some = large.limit(1).count() > 0
    small = named.join(large, same, "left_anti") if some else named
    out = small.groupBy("_group").agg(*(F.median(c).alias(f"median_{c}") for c in columns))
    if some:
        hot = large.select(F.col("_large").alias("_group"))
        for c in columns:
            placed = positions(named.join(large, same, "left_semi").select("_group", c).dropna(subset=[c]), ["_group"], [F.col(c)], "_place")
            last = placed.groupBy(F.col("_group").alias("_g")).agg(F.max("_place").alias("_n"))
            middle = placed.join(last, F.col("_group").eqNullSafe(F.col("_g"))).filter(F.col("_place").between(F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")))
            middle = middle.groupBy("_g").agg(F.avg(c).alias(f"median_{c}"))
            hot = hot.join(middle, F.col("_group").eqNullSafe(F.col("_g")), "left").drop("_g")
        out = out.unionByName(hot)
    return out.withColumnRenamed("_group", group)


def mapping_rates(resolved: DataFrame, continuity: tuple[str, ...]) -> DataFrame:
    """Shares of each run's rows that resolution inferred, confirmed, resolved by itself, and carried on from elsewhere."""
    there = ~F.col("dropped").eqNullSafe("extra")
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4)
    kept = F.col("dropped").isNull()
    return resolved.groupBy("run_date").agg(
        rate(F.col("inferred") & there).alias("sequential_rate"), rate(F.col("counted_confirmation") & there).alias("confirmed_rate"),
        rate(kept & (F.col("final_status") == "ready_auto_resolved")).alias("auto_resolved_rate"), rate(kept & F.col("resolution_source").isin(*continuity)).alias("continuity_rate"),
    )


def batch_profile(rows: DataFrame) -> DataFrame:
    """Quality profile of each run; rates have all rows of the run below the line, medians the rows that have the value.

    rows: (run_date, label, caption, ocr_excerpt, width, height, blur, brightness, has_crop).
    """
    labels = {k: F.count_if(c).alias(f"{k}_rows") for k, c in (("tomato", F.col("label") == "tomato"), ("non_tomato", F.col("label") == "non_tomato"), ("unknown", ~F.coalesce(F.col("label").isin("tomato", "non_tomato"), F.lit(False))))}
    long_side = F.greatest("width", "height")
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4)
    out = rows.groupBy("run_date").agg(
        F.count("*").alias("total_rows"), *labels.values(), rate(F.trim("caption") != "").alias("caption_rate"), rate(F.trim("ocr_excerpt") != "").alias("ocr_rate"),
        rate(F.col("label").isin("tomato", "non_tomato")).alias("non_unknown_rate"), rate(F.col("has_crop")).alias("crop_rate"), rate(long_side <= 700).alias("low_resolution_rate"), rate(long_side >= 2000).alias("full_resolution_rate"),
        rate(F.col("height") > F.col("width")).alias("portrait_rate"), rate(F.col("width") > F.col("height")).alias("landscape_rate"),
    )
    zero = {f"median_{c}": F.round(F.coalesce(f"median_{c}", F.lit(0.0)), 4) for c in ("blur", "brightness")}
    return out.join(medians(rows, "run_date", ["blur", "brightness"]).withColumns(zero), "run_date")


def run_mode(rows: Column, caption: Column, known: Column, full: Column, sequential: Column) -> Column:
    return (
        F.when((caption >= 0.70) & (known >= 0.60) & (full >= 0.50), "baseline")
        .when(rows.between(30, 34) & (sequential >= 0.90) & (known <= 0.20), "watering_day")
        .otherwise("random")
    )


def drift(profiles: DataFrame) -> DataFrame:
    """Latest run against the latest baseline run: (latest_run, baseline_run, unknown_latest, unknown_baseline, random_runs)."""
    unknown = 1 - F.col("non_unknown_rate")
    is_base = F.col("mode") == "baseline"
    return profiles.agg(
        F.max("run_date").alias("latest_run"), F.max(F.when(is_base, F.col("run_date"))).alias("baseline_run"), F.max_by(unknown, F.col("run_date")).alias("unknown_latest"),
        F.max_by(F.when(is_base, unknown), F.when(is_base, F.col("run_date"))).alias("unknown_baseline"), F.count_if(F.col("mode") == "random").alias("random_runs"),
    )


def variation(df: DataFrame, metrics: list[str], available: float = 0.9, varied: float = 0.15, fair: float = 0.6) -> DataFrame:
    """Availability and coefficient of variation of each metric, and how helpful it is."""
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    long = df.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, value)")
    cv = F.when((F.count("value") < 2) | (F.abs(F.avg("value")) < 1e-12), 0.0).otherwise(F.stddev_pop("value") / F.abs(F.avg("value")))
    out = long.groupBy("metric").agg((F.count("value") / F.count("*")).alias("availability"), F.coalesce(cv, F.lit(0.0)).alias("cv"))
    status = F.when((F.col("availability") >= available) & (F.col("cv") >= varied), "helpful").when(F.col("availability") >= fair, "promising").otherwise("limited")
    return out.withColumn("status", status)


def calibration(manual: DataFrame, predicted: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Accuracy of each field and of all together; missing predictions count as wrong."""
    joined = manual.join(predicted.select(key, F.lit(True).alias("_has"), *(F.col(f).alias(f"_p_{f}") for f in fields)), key, "left")
    right = {f: F.coalesce(F.col(f) == F.col(f"_p_{f}"), F.lit(False)) for f in fields}
    both = right[fields[0]]
    for f in fields[1:]:
        both = both & right[f]
    acc = lambda c: F.avg(c.cast("int"))
    return joined.agg(
        F.count("*").alias("rows"), F.count_if(F.col("_has").isNull()).alias("missing"), *(acc(right[f]).alias(f"{f}_accuracy") for f in fields), acc(both).alias("joint_accuracy")
    )


def presence_audit(manual: DataFrame, predicted: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rates over joined rows. manual: (key, subjects, classes arrays); predicted: (key, subject_id, class_number); pairs: (key,
    subject_id, class_number), the boxes that were paired: a row is exact if one of its pairs is the predicted one."""
    exact = pairs.dropna(subset=["subject_id", "class_number"]).select(key, "subject_id", "class_number").distinct().withColumn("exact", F.lit(True))
    j = manual.join(predicted, key).join(exact, [key, "subject_id", "class_number"], "left")
    has_s, has_c = F.array_contains("subjects", F.col("subject_id")), F.array_contains("classes", F.col("class_number"))
    strict = (F.size("subjects") == 1) & (F.size("classes") == 1)
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return j.agg(
        F.count("*").alias("joined"), rate(has_s).alias("subject_rate"), rate(has_c).alias("class_rate"), rate(has_s & has_c).alias("both_rate"), rate(F.col("exact")).alias("exact_rate"),
        F.count_if(strict).alias("strict_rows"), F.count_if(F.coalesce(strict & has_s & has_c, F.lit(False))).alias("strict_right"),
    )


def failures(manual: DataFrame, predicted: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(pattern): one row for each fault of a joined row and of its pairs (key, subject_id, expected, class_number, review_reason)."""
    j = manual.join(predicted, key)
    said = lambda d, test, *parts: d.filter(test).select(F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).alias("pattern"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    subject, number = F.col("subject_id"), text("class_number")
    own = pairs.join(j.select(key), key, "left_semi")
    out = [
        said(own, F.col("review_reason") == "pot_varietal_conflict", "conflict: pot ", text("subject_id"), " expected ", text("expected"), " labeled ", number),
        said(own, (F.col("review_reason") == "missing_varietal_pair") & subject.isNotNull(), "missing_varietal_for_pot: ", subject),
        said(own, (F.col("review_reason") == "orphan_varietal_without_pot") & F.col("class_number").isNotNull(), "orphan_varietal: ", number),
        said(j, subject.isNotNull() & ~F.array_contains("subjects", subject), "pipeline_pot_not_in_manual_set: ", subject),
        said(j, (F.col("class_number") > 0) & ~F.array_contains("classes", F.col("class_number")), "pipeline_series_not_in_manual_set: ", number),
    ]
    return reduce(DataFrame.unionByName, out)


def variant_ranking(tries: DataFrame) -> DataFrame:
    """tries: (row_key, variant, text, numbers, truth). Rates of each variant, the best first."""
    hit = F.coalesce(F.array_contains("numbers", F.col("truth")), F.lit(False)).cast("int")
    out = tries.groupBy("variant").agg(
        F.count("*").alias("rows"), F.count_if(F.col("text") != "").alias("text_rows"), F.count_if(F.size("numbers") > 0).alias("number_rows"),
        F.round(F.avg(hit), 4).alias("match_rate"), F.round(F.avg(F.length("text")), 2).alias("mean_length"),
    )
    return out.orderBy(F.desc("match_rate"), "variant")


def ensemble(tries: DataFrame) -> DataFrame:
    """Per row: does any variant's number equal the truth."""
    hit = F.coalesce(F.array_contains("numbers", F.col("truth")), F.lit(False))
    return tries.groupBy("row_key").agg(F.max(hit).alias("matched"))


def signal_cards(rows: DataFrame, group: str, bucket: str) -> DataFrame:
    """Counts per bucket of each group, and a word for the whole."""
    names = ["strong", "modest", "flat", "stalled", "unscored"]
    out = rows.groupBy(group).agg(F.count("*").alias("rows"), *(F.count_if(F.col(bucket) == b).alias(b) for b in names))
    word = (
        F.when(F.col("stalled") > 0, "mixed").when((F.col("strong") == F.col("rows")) & (F.col("strong") > 1), "leading")
        .when((F.col("strong") > 0) & (F.col("modest") > 0), "mixed_promising").when(F.col("strong") > 0, "positive").otherwise("needs_proof")
    )
    return out.withColumn("signal", word)


def status_groups(rows: DataFrame, column: str, statuses: list[str]) -> DataFrame:
    """Counts of a fixed list of statuses, zero where there is none."""
    spine = rows.sparkSession.range(len(statuses)).select(F.element_at(F.array(*(F.lit(s) for s in statuses)), (F.col("id") + 1).cast("int")).alias("status"))
    found = rows.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))
    return spine.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def top_per_group(rows: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def override_summary(overrides: DataFrame) -> DataFrame:
    """overrides: (run_date, subject_id, class_number, confirmed, suggested, reviewed)."""
    return overrides.groupBy("run_date").agg(
        F.count("*").alias("rows"), F.count_if("reviewed").alias("reviewed_rows"), F.count_if(F.coalesce(F.col("confirmed") != F.col("suggested"), F.lit(False))).alias("changed_rows")
    )


def catalog_completion(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"), F.count_distinct("species").alias("species"), F.min("run_date").alias("first_run"), F.max("run_date").alias("last_run"),
        F.round(100 * F.avg((F.col("label") != "unknown").cast("int")), 2).alias("completion"),
    )


#: Fixed value: how a message names a subject.
MESSAGE_SUBJECT = r"(?i)\bpot\s+([0-9]{1,3}T)\b"


def with_subject(messages: DataFrame, column: str) -> DataFrame:
    """The messages that name a subject, with subject_id."""
    subject = ids.subject_id(F.nullif(F.regexp_extract(column, MESSAGE_SUBJECT, 1), F.lit("")))
    return messages.withColumn("subject_id", subject).filter("subject_id IS NOT NULL")


def subjects_in_messages(messages: DataFrame, column: str) -> DataFrame:
    """(subject_id, n): how many messages name each subject."""
    return with_subject(messages, column).groupBy("subject_id").agg(F.count("*").alias("n"))


def subject_cards(compared: DataFrame, messages: DataFrame, column: str) -> DataFrame:
    """compared (two runs over a spine of subjects) with the number of the later run's messages that name the subject."""
    return compared.join(subjects_in_messages(messages, column), "subject_id", "left").withColumn("warnings", F.coalesce("n", F.lit(0))).drop("n")


def metric_summary(rows: DataFrame) -> DataFrame:
    """One row for a metric run. rows: (focus, coverage, inner_spill, neighbor_spill, growth, next_step)."""
    mean = lambda c, d: F.coalesce(F.round(F.avg(c), d), F.lit(0.0)).alias(f"mean_{c}")
    return rows.agg(
        F.count("*").alias("subjects"), mean("focus", 3), mean("coverage", 6), mean("inner_spill", 6), mean("neighbor_spill", 6),
        F.coalesce(F.round(F.count("growth") / F.nullif(F.count("*"), F.lit(0)), 3), F.lit(0.0)).alias("growth_availability"), F.count_if(F.col("next_step") == "ready").alias("ready"),
    )


def run_cards(rows: DataFrame, continuity: tuple[str, ...], n: int) -> DataFrame:
    """Per run: kept rows, subjects, confirmed rows, rows resolved by continuity, how many of 1..n are missing, and which."""
    kept = rows.filter("dropped IS NULL")
    number = F.regexp_extract("subject_id", "^([0-9]+)T$", 1).try_cast("bigint")
    there = F.collect_set(F.when(number.between(1, n), number))  # n numbers at most
    gone = F.array_except(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint")), there)
    return kept.groupBy("run_date").agg(
        F.transform(F.array_sort(gone), lambda x: F.concat(x.cast("string"), F.lit("T"))).alias("missing_ids"),
        F.count("*").alias("rows"), F.count_distinct("subject_id").alias("subjects"), F.count_if("ocr_confirmed").alias("confirmed_rows"),
        F.count_if(F.col("resolution_source").isin(*continuity)).alias("continuity_rows"), (n - F.count_distinct(F.when(number.between(1, n), number))).alias("missing"),
    )


def comparison_insight(compared: DataFrame, cards: DataFrame, messages: DataFrame, first, second, n: int) -> DataFrame:
    """Two runs in one row: subjects at risk and partly confirmed, confirmed rows and warnings of both, and the kind of headline.

    compared is the comparison over the spine of n subjects; cards has a row for each run, messages (run_date, severity).
    """
    warned = messages.filter("severity = 'warning'").groupBy("run_date").agg(F.count("*").alias("warnings"))
    cards = cards.join(warned, "run_date", "left")
    side = lambda d, s: cards.filter(F.col("run_date") == F.lit(d)).agg(F.max("rows").alias(f"rows_{s}"), F.max("confirmed_rows").alias(f"confirmed_{s}"), F.coalesce(F.max("warnings"), F.lit(0)).alias(f"warnings_{s}"))
    counts = compared.agg(F.count_if(F.col("status") == "risk").alias("at_risk"), F.count_if(F.col("status") == "info").alias("partial"))
    out = counts.join(F.broadcast(side(first, "a")), F.lit(True)).join(F.broadcast(side(second, "b")), F.lit(True))
    kind = F.when((F.col("rows_b") == n) & (F.col("rows_a") > n), "census_after_sweep").when(F.col("rows_b") == n, "complete").otherwise("batch")
    return out.withColumn("headline", kind)


def top_category(rows: DataFrame, column: str) -> DataFrame:
    """The most frequent value with its count, ties by name."""
    return value_counts(rows.dropna(subset=[column]), column).limit(1)


def ingest_summary(tasks: DataFrame) -> DataFrame:
    """tasks: (status). Counts of ready and pending tasks, and the advice that follows from them."""
    out = tasks.agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "ready").alias("ready"), F.count_if(F.col("status").isin("pending", "started_empty")).alias("pending"))
    return out.withColumn("advice", F.when(F.col("ready") >= 8, "benchmark").when(F.col("ready") >= 4, "baseline").when(F.col("pending") > 0, "annotate").otherwise("unblock"))


def box_typing(boxes: DataFrame, key: str) -> DataFrame:
    """Per photo, from typed boxes: boxes, those with a text, their share, and counts of kinds and of different values.

    Values are numbers of up to three digits, so a photo's sets of them stay small whatever the number of its boxes.
    """
    kind = lambda k: F.count_if(F.col("kind") == k)
    values = lambda k: F.size(F.collect_set(F.when(F.col("kind") == k, F.col("value")))).cast("long")
    return boxes.groupBy(key).agg(
        F.count("*").alias("boxes"), F.round(F.avg((F.col("kind") != "unlabeled").cast("int")), 4).alias("typed_ratio"), kind("pot").alias("pots"), kind("varietal").alias("varietals"),
        kind("other").alias("others"), values("pot").alias("pot_ids"), values("varietal").alias("varietal_numbers"),
    )


def box_values(boxes: DataFrame, key: str) -> DataFrame:
    """(key, kind, value, n): how often a photo's boxes name each subject id and class number."""
    return boxes.filter(F.col("kind").isin("pot", "varietal") & F.col("value").isNotNull()).groupBy(key, "kind", "value").agg(F.count("*").alias("n"))


def pair_counts(verdicts: DataFrame, column: str) -> DataFrame:
    """(value, n) of the reasons or kinds of evidence of all photos together; no reason is no value."""
    return value_counts(verdicts.filter(F.col(column) != ""), column)


def pair_summary(verdicts: DataFrame, key: str) -> DataFrame:
    """Photos, rows, rows for review and rows settled without one."""
    return verdicts.agg(
        F.count_distinct(key).alias("photos"), F.count("*").alias("rows"), F.count_if("needs_review").alias("needs_review"), F.count_if(~F.col("needs_review")).alias("auto_resolved")
    )


def page_stats(subjects: DataFrame, metrics: DataFrame, start, end) -> DataFrame:
    """One row. subjects: (subject_id, variety_name, bucket, batch_label); metrics: (subject_id, growth). A batch label
    counts if all subjects that have one agree."""
    bucket = lambda *b: F.count_if(F.col("bucket").isin(*b))
    label = F.nullif(F.trim("batch_label"), F.lit(""))
    one = F.when(F.min(label) == F.max(label), F.min(label))
    found = subjects.agg(
        F.count("*").alias("subjects"), F.count_distinct("variety_name").alias("varieties"), bucket("strong").alias("strong"), bucket("modest", "stalled").alias("watch"),
        bucket("stalled").alias("stalled"), F.coalesce(one, F.lit("Canonical end-batch selection")).alias("batch_label"),
    )
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
    m = metrics.agg(F.count("*").alias("metric_rows"), F.count("growth").alias("growth_rows"))
    return found.join(F.broadcast(m), F.lit(True)).withColumns({"days_between": days, "inclusive_days": days + 1})


def triage_summary(rows: DataFrame, expected) -> DataFrame:
    """One row. rows: (subject_id, run_b_date, batch_id, row_index, missing). Whether all are there, and whether the
    expected date is the only one."""
    text = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    gone = F.lower(F.trim(F.coalesce("missing", F.lit("")))).isin("1", "true", "yes", "y")
    out = rows.agg(
        F.count("*").alias("rows"), F.count_distinct(text("subject_id")).alias("subjects"), F.count_distinct("run_b_date").alias("dates"), F.count_distinct(text("batch_id")).alias("batches"),
        F.count_distinct(F.when(F.col("row_index") > 0, F.col("row_index"))).alias("row_indexes"), F.coalesce(F.bool_and(~gone), F.lit(True)).alias("all_rows_present"), F.max("run_b_date").alias("_last"),
    )
    matched = (F.col("dates") == 1) & (F.col("_last") == F.lit(expected))
    return out.withColumn("expected_end_matched", F.coalesce(matched, F.lit(False))).drop("_last")


def annotation_summary(manifest: DataFrame) -> DataFrame:
    """One row. manifest: (annotation_status, mismatch)."""
    status = lambda s: F.count_if(F.col("annotation_status") == s)
    return manifest.agg(
        F.count("*").alias("expected"), status("completed").alias("completed"), status("started_empty").alias("started_empty"), status("pending").alias("pending"), F.count_if("mismatch").alias("mismatches")
    )


def annotation_counts(manifest: DataFrame) -> DataFrame:
    """(kind, value, n): reviewers, and the labels of the `|`-parted lists."""
    labels = F.transform(F.split(F.coalesce("labels", F.lit("")), r"\|"), lambda v: F.struct(F.lit("label").alias("kind"), F.trim(v).alias("value")))
    each = F.explode(F.concat(F.array(F.struct(F.lit("reviewer").alias("kind"), F.trim(F.coalesce("reviewer", F.lit(""))).alias("value"))), labels))
    return manifest.select(each.alias("e")).filter(F.col("e.value") != "").groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))


def queue_summary(rows: DataFrame, columns: tuple[str, ...] = ("run_date", "matches", "signal")) -> DataFrame:
    """(kind, value, n): the values of each column, as text."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("value")) for c in columns)))
    return rows.select(each.alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n"))
