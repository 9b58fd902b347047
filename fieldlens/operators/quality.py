"""Gates: violations are rows, and an empty table passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from . import intervals, rank


def phase_consistency(rows: DataFrame) -> DataFrame:
    """(code, item): subjects twice in a run, and subjects with several classes or names over the runs."""
    twice = rows.groupBy("run_date", "subject_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_in_run").alias("code"), F.concat_ws("|", F.col("run_date").cast("string"), "subject_id").alias("item"))
    over = rows.groupBy("subject_id").agg(F.count_distinct("class_number").alias("c"), F.count_distinct("variety_name").alias("v"))
    several = lambda c, n: over.filter(F.col(c) > 1).select(F.lit(n).alias("code"), F.col("subject_id").alias("item"))
    return twice.unionByName(several("c", "several_classes")).unionByName(several("v", "several_names"))


def effective_end(phases: DataFrame, runs: DataFrame) -> DataFrame:
    """(phase_id, effective_end, basis): where a phase ends for checks.

    phases: (phase_id, start_date, end_date, priority, explicit_end). The configured end holds unless the next phase
    begins on or before it; then it holds if a batch was named as the end, else the latest run from the phase's start
    and before the next one's stands for it, if there is one. A phase without an end has none.
    """
    # the next phase's start is the last one met from the other end, so no task holds all phases
    reverse = [-F.unix_date("start_date"), F.col("priority").isNull(), -F.col("priority")]
    p = phases.select("phase_id", "start_date", "end_date", "priority", F.coalesce("explicit_end", F.lit(False)).alias("explicit"))
    p = rank.running(p, [], reverse, {"next": ("last", F.col("start_date"))}, current=False).drop("priority")
    found = intervals.last_within(p.withColumn("before_next", F.date_sub("next", 1)), ["phase_id"], "start_date", "before_next", runs, "run_date", "last_run")
    overlap = F.coalesce((F.col("next") <= F.col("end_date")) & F.col("start_date").isNotNull(), F.lit(False))
    basis = (
        F.when(F.col("end_date").isNull(), "missing_phase_end").when(~overlap, "timeline_end").when(F.col("explicit"), "explicit_end_batch")
        .when(F.col("last_run").isNull(), "no_run_before_next").otherwise("latest_run_before_next")
    )
    out = p.join(found, "phase_id", "left").withColumn("basis", basis)
    return out.select("phase_id", F.when(F.col("basis") == "latest_run_before_next", F.col("last_run")).otherwise(F.col("end_date")).alias("effective_end"), "basis")


def checked(rows: DataFrame, caption: str, registry_keys: DataFrame) -> DataFrame:
    """rows with `reject`: the first reason that fails, or null."""
    from ..functions.ids import slug

    keys = registry_keys.select(F.col("key").alias("_key")).distinct().withColumn("_known", F.lit(True))
    parts = text.caption_parts(F.col(caption))
    j = rows.withColumn("_parts", parts).withColumn("_key", slug(F.col("_parts.variety"))).join(keys, "_key", "left")
    reject = F.coalesce("_parts.reject", F.when(F.col("_known").isNull(), "unknown_variety"))
    return j.withColumn("reject", reject).drop("_parts", "_key", "_known")


def anchors(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(code, item) for each count that is not as expected; df has one row with those columns."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT), CAST({int(v)} AS BIGINT)" for c, v in expected.items())
    long = df.selectExpr(f"stack({len(expected)}, {pairs}) AS (item, found, wanted)")
    return long.filter("NOT (found <=> wanted)").select(F.lit("count_differs").alias("code"), F.concat("item", F.lit("="), F.coalesce(F.col("found").cast("string"), F.lit("null"))).alias("item"))


def anchor_runs(overrides: DataFrame, batch: DataFrame | None = None) -> DataFrame:
    """(run_date, rows, reviewed_rows, subjects) of each run's overrides; subjects are different ids of reviewed rows.

    batch: (run_date, row_index), rows chosen by hand. A run that it names counts only these.
    """
    rows = overrides.dropna(subset=["run_date"])
    if batch is not None:
        chosen = batch.select("run_date", "row_index").distinct()
        named = chosen.select("run_date").distinct()
        rows = rows.join(named, "run_date", "left_anti").unionByName(rows.join(chosen, ["run_date", "row_index"], "left_semi"))
    seen = ids.truthy(F.col("reviewed"))
    return rows.groupBy("run_date").agg(
        F.count("*").alias("rows"), F.count_if(seen).alias("reviewed_rows"), F.count_distinct(F.when(seen, ids.subject_id(F.col("confirmed_subject")))).alias("subjects")
    )


def anchor_marks(overrides: DataFrame, run, subject: str, gone: int, chosen: int, mark: str) -> DataFrame:
    """What a run's overrides say about a subject and two rows, in one row: whether it is declared missing, has a reviewed
    row, and whether row `gone` is excluded and the notes of row `chosen` have the mark. A run without overrides says no."""
    notes, index = F.col("notes"), F.col("row_index")
    says = {
        "declared_missing": F.array_contains(ids.declared_missing(notes), subject),
        "has_row": ids.truthy(F.col("reviewed")) & (ids.subject_id(F.col("confirmed_subject")) == subject),
        "excluded_row": (index == gone) & ids.excludes_row(notes),
        "chosen_row": (index == chosen) & notes.contains(mark),
    }
    return overrides.filter(F.col("run_date") == F.lit(run)).agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in says.items()))
