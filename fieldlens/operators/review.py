"""Human reviews: hard cases as canonical rows, tags of two runs, diagnostics of a reviewed run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from .lookup import last_wins
from .rank import positions

KEYS = ["run_date", "row_index", "asset"]
#: Verdicts that take a row out.
EXCLUDING_VERDICTS = ("exclude", "excluded", "reject", "rejected", "discard", "drop", "do_not_use", "not_tomato", "non_tomato", "nontomato")


def _aligned(named: Column, mapped: Column, keep: Column) -> tuple[Column, Column]:
    """The class of a subject: the map's, unless it has none or the reviewer's own is kept; and whether the map changed it."""
    moved = F.coalesce(~keep & (named != mapped), F.lit(False))
    return F.when(keep, F.coalesce(named, mapped)).otherwise(F.coalesce(mapped, named)), moved


def canonical_reviews(review: DataFrame, queue: DataFrame, labeled: DataFrame, names: DataFrame, subject_classes: DataFrame) -> DataFrame:
    """Reviewed hard cases as canonical override rows, one for each key of the queue (of the review if the queue is empty).

    review: (KEYS, photo_url, suggested_subject, confirmed_subject, suggested_name, confirmed_name, verdict, do_not_use,
    notes); queue: (KEYS, photo_url, subject_id, variety_name); labeled: (KEYS, photo_url), with one row a key in each.
    names: (series_name, series_number, row_index); subject_classes: (subject_id, series_number, row_index). What is
    not confirmed is taken as suggested; classes follow the subject's map unless the notes keep them.
    """
    said = lambda d, cols, p: d.select(*KEYS, *(ids.strip(F.col(c)).alias(f"_{p}_{c}") for c in cols))
    r = said(review, ("photo_url", "suggested_subject", "confirmed_subject", "suggested_name", "confirmed_name", "verdict", "do_not_use", "notes"), "r").withColumn("_known", F.lit(True))
    j = (review if queue.isEmpty() else queue).select(*KEYS).distinct().join(r, KEYS, "left")
    j = j.join(said(queue, ("photo_url", "subject_id", "variety_name"), "q"), KEYS, "left").join(said(labeled, ("photo_url",), "l"), KEYS, "left")
    suggested = ids.subject_id(F.coalesce("_r_suggested_subject", "_q_subject_id"))
    j = j.withColumn("suggested_subject", suggested).withColumn("confirmed_subject", F.coalesce(ids.subject_id(F.col("_r_confirmed_subject")), F.col("suggested_subject")))
    j = j.withColumn("_sk", ids.canonical_key(F.coalesce("_r_suggested_name", "_q_variety_name"))).withColumn("_ck", ids.canonical_key(F.col("_r_confirmed_name")))
    by_name = last_wins(names.select(F.nullif(ids.canonical_key(F.col("series_name")), F.lit("")).alias("_k"), F.col("series_number").alias("_n"), "row_index"), ["_k"], "row_index")
    by_subject = last_wins(subject_classes.select(F.col("subject_id").alias("_k"), F.col("series_number").alias("_n"), "row_index"), ["_k"], "row_index")
    for table, key, found in ((by_name, "_sk", "_sn"), (by_name, "_ck", "_cn"), (by_subject, "suggested_subject", "_sm"), (by_subject, "confirmed_subject", "_cm")):
        j = j.join(table.select(F.col("_k").alias(key), F.col("_n").alias(found)), key, "left")
    low = F.lower(F.coalesce("_r_notes", F.lit("")))
    s, s_moved = _aligned(F.col("_sn"), F.col("_sm"), low.contains("keep_suggested_varietal=1"))
    c, c_moved = _aligned(F.col("_cn"), F.col("_cm"), low.contains("keep_confirmed_varietal=1") | low.contains("varietal_lock=1"))
    gone = ids.truthy(F.col("_r_do_not_use")) | F.coalesce(F.lower("_r_verdict").isin(*EXCLUDING_VERDICTS), F.lit(False))
    notes = text.note_join(
        F.col("_r_notes"), F.lit("phase2_start=1"), F.when(low.contains("in a pot"), "phase2_micro_env=indoor_artificial_light").otherwise("phase2_micro_env=outdoor_sun"),
        F.when(gone, "exclude_row=1"), F.when(s_moved, "suggested_varietal_aligned_to_pot_map=1"), F.when(c_moved, "confirmed_varietal_aligned_to_pot_map=1"),
        F.when(F.col("_known").isNull(), "phase2_fallback=accepted_queue_suggestion"),
    )
    return j.select(
        *KEYS, F.coalesce("_r_photo_url", "_q_photo_url", "_l_photo_url").alias("photo_url"), "suggested_subject", F.coalesce(s, c).alias("suggested_class"),
        "confirmed_subject", F.coalesce(c, s).alias("confirmed_class"), gone.alias("exclude_row"), notes.alias("notes"),
    )


def tag_rows(raw: DataFrame) -> DataFrame:
    """Rows of a tagging export with normal ids, classes, row numbers and flags; raw has the same columns as text."""
    t = lambda c: ids.strip(F.col(c))
    return raw.select(
        t("run_date").alias("run_date"), ids.safe_int(F.col("row_index")).alias("row_index"), t("asset").alias("asset"), t("photo_url").alias("photo_url"),
        ids.subject_id(F.col("suggested_subject")).alias("suggested_subject"), ids.class_number(F.col("suggested_class")).alias("suggested_class"),
        ids.subject_id(F.col("confirmed_subject")).alias("confirmed_subject"), ids.class_number(F.col("confirmed_class")).alias("confirmed_class"),
        ids.truthy(F.col("reviewed"), on=False).alias("reviewed"), t("notes").alias("notes"),
    )


def tag_summary(tags: DataFrame) -> DataFrame:
    """Per run: rows, reviewed rows, and rows whose confirmed subject or class is not the suggested one."""
    same = F.col("confirmed_subject").eqNullSafe(F.col("suggested_subject")) & F.col("confirmed_class").eqNullSafe(F.col("suggested_class"))
    return tags.groupBy("run_date").agg(F.count("*").alias("rows"), F.count_if("reviewed").alias("reviewed_rows"), F.count_if(~same).alias("changed_rows"))


def several_classes(tags: DataFrame) -> DataFrame:
    """(subject_id, classes): subjects confirmed with more than one class; classes are few, as they are series numbers."""
    known = tags.filter("confirmed_subject IS NOT NULL AND confirmed_class IS NOT NULL")
    out = known.groupBy(F.col("confirmed_subject").alias("subject_id")).agg(F.array_sort(F.collect_set("confirmed_class")).alias("classes"))
    return out.filter(F.size("classes") > 1)


def subject_checks(rows: DataFrame, n: int) -> DataFrame:
    """(run_date, code, subject_number): of the rows not excluded, subjects seen twice in a run and those of 1..n missing."""
    counted = rows.filter("NOT exclude_row AND confirmed_subject IS NOT NULL")
    each = counted.groupBy("run_date", ids.subject_number(F.col("confirmed_subject")).alias("subject_number")).agg(F.count("*").alias("n"))
    twice = each.filter("n > 1").select("run_date", F.lit("duplicate").alias("code"), "subject_number")
    spine = rows.select("run_date").distinct().select("run_date", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))).alias("subject_number"))
    missing = spine.join(each, ["run_date", "subject_number"], "left_anti").select("run_date", F.lit("missing").alias("code"), "subject_number")
    return twice.unionByName(missing)


def first_of_run(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows of each run by row_index, and (run_date, rows) of the runs that have fewer."""
    short = rows.groupBy("run_date").agg(F.count("*").alias("rows")).filter(F.col("rows") < n)
    return positions(rows, ["run_date"], [F.col("row_index")], "position").filter(F.col("position") <= n), short


def identity_verdict(given: Column, expected: Column, verdict: Column, corrected: Column) -> Column:
    """struct(effective, mismatch): the given id, else the corrected one of a rejected prefill, else the expected one."""
    up = lambda c: F.upper(ids.strip(c))
    fixed = F.when(ids.strip(verdict) == "reject_prefilled", up(corrected))
    return F.struct(F.coalesce(up(given), fixed, up(expected)).alias("effective"), (fixed.isNotNull() & ~fixed.eqNullSafe(up(expected))).alias("mismatch"))


def two_tier_labels(rows: DataFrame, crop: str, full: str) -> DataFrame:
    """rows with label, species, caption, notes and ocr_excerpt: the crop's text decides, else both texts together.

    rows: (row_index, caption, notes) and the two texts. Rows of other species get a caption, if blank, and a note of the text.
    """
    near = ids.strip(F.col(crop))
    first = text.classify_text(near)
    both = F.when(first["label"] == "unknown", F.nullif(F.concat_ws(" | ", near, ids.strip(F.col(full))), F.lit(""))).otherwise(near)
    out = rows.withColumn("_t", both).withColumn("_c", text.classify_text(F.col("_t")))
    other = F.col("_c.label") == "non_tomato"
    made = F.concat_ws(" | ", F.col("_c.common"), F.format_string("non_tomato_%02d", F.col("row_index")), F.lit("unknown"))
    note = F.concat_ws("; ", ids.strip(F.col("notes")), F.coalesce(F.concat(F.lit("OCR: "), F.substring("_t", 1, 200)), F.lit("OCR: no text")))
    out = out.withColumns({
        "label": F.col("_c.label"), "species": F.coalesce("_c.common", F.lit("unknown")), "caption": F.when(other, F.coalesce(ids.strip(F.col("caption")), made)).otherwise(F.col("caption")),
        "notes": F.when(other, note).otherwise(F.col("notes")), "ocr_excerpt": F.substring("_t", 1, 500),
    })
    return out.drop("_t", "_c")
