"""Identity resolution: which subject and class each row of a run shows, from layered evidence, for all runs at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..sources.shared import checked, stored
from .lookup import last_wins, phase_of, told_index, with_told
from .rank import positions


@dataclass(frozen=True)
class Params:
    expected: int = 32
    #: Runs of so many rows are expected to have `expected` subjects, others as many as they have rows; without it all have `expected`.
    usual_sizes: tuple[int, int] | None = None
    sequential: bool = True
    target_only_run: bool = True
    baseline_reconcile: bool = True
    name_fallback: bool = False
    potting_date: str = "2026-02-24"
    day_one: str = "2026-02-25"
    stage: str = "sapling"
    most_class: int = 40


LOG = "array<struct<code:string,values:array<string>>>"

#: Severity and wording of what is noted about a row; {0} is its row_index.
ROW_TEXTS = {
    "extra_row": ("warning", "row {0}: skipped extra row beyond expected_pots={1} with no explicit pot_id"),
    "override_series": ("warning", "row {0}: pot {1} override series={2} replaces detected series={3}"),
    "baseline_series": ("warning", "row {0}: baseline series={1} replaces detected series={2} for pot {3}"),
    "override_variety": ("warning", "row {0}: pot {1} override variety '{2}' replaces detected variety '{3}'"),
    "baseline_variety": ("warning", "row {0}: baseline variety '{1}' replaces detected variety '{2}' for pot {3}"),
    "packet_name": ("warning", "row {0}: packet_number={1} maps to '{2}' but row variety is '{3}'"),
    "row_override_subject": ("warning", "row {0}: manual row override pot_id={1} replaces inferred pot_id={2}"),
    "row_override_class": ("warning", "row {0}: manual row override varietal={1} replaces inferred varietal={2}"),
    "row_override_variety": ("warning", "row {0}: manual row override variety '{1}' replaces inferred variety '{2}'"),
    "excluded_row": ("warning", "row {0}: excluded by manual row override"),
    "missing_pot_id": ("error", "row {0}: tomato row is missing pot_id (expected format like 12T)"),
    "missing_variety_name": ("error", "row {0}: tomato row is missing variety_name/species mapping"),
}


def _differs(a: Column, b: Column) -> Column:
    return F.coalesce(ids.canonical_key(a) != ids.canonical_key(b), F.lit(False))


def _say(pattern: str, *values) -> Column:
    """A text with a value for each {}."""
    parts = pattern.split("{}")
    out = [F.lit(parts[0])]
    for value, after in zip(values, parts[1:]):
        out += [(F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(after)]
    return F.concat(*out)


def _noted(rows: DataFrame, *entries: tuple[Column, str, list[str]]) -> DataFrame:
    """rows with further entries of the log, (condition, code, columns), in their order. Texts are made where they are read."""
    made = [F.when(c, F.struct(F.lit(code).alias("code"), F.array(*(F.col(v).cast("string") for v in values)).cast("array<string>").alias("values"))) for c, code, values in entries]
    return rows.withColumn("log", F.concat("log", F.array_compact(F.array(*made))))


def _row_text(code: Column, row_index: Column, values: Column) -> Column:
    """The wording of an entry of the log."""
    pattern = F.coalesce(*(F.when(code == k, F.lit(t)) for k, (_, t) in ROW_TEXTS.items()))
    parts = F.split(pattern, r"\{[0-9]\}")
    filled = F.zip_with(parts, F.concat(F.array(row_index.cast("string")), values), lambda p, v: F.concat(p, F.coalesce(v, F.lit(""))))
    return F.array_join(filled, "")


def resolve_identities(
    intake: DataFrame, series: DataFrame, subject_series: DataFrame, baseline: DataFrame, overrides: DataFrame, p: Params = Params()
) -> DataFrame:
    """One row for each intake row, kept or not, with its identity, the evidence codes and the status.

    intake: (row_index, run_date, asset, label, pot_tag, packet_tag, notes, caption, ocr_excerpt, variety_name,
    species_common_name). series: (series_number, series_name). subject_series: (subject_id, series_number).
    baseline: (subject_id, baseline_name). overrides: (run_date, row_index, asset, confirmed_subject, confirmed_class,
    notes, reviewed), ignored unless reviewed. The small dimensions carry row_index; the last row of a key wins.

    `dropped` says why a row is not part of the mapping (extra, excluded), else it is null. `log` has what happened to the
    row, an array of (code, values) in the order of the steps: evidence that other evidence replaces, and an identity that
    stays incomplete; ROW_TEXTS has their severity and wording.
    """
    entries = series.withColumn("series_name", text.alias(F.col("series_name"))).dropna(subset=["series_number"])
    names = entries.groupBy("series_number").agg(F.max_by("series_name", "row_index").alias("series_name"), F.min("row_index").alias("entered"))
    # of numbers with the same name, the one that was entered last
    reverse = names.withColumn("key", ids.canonical_key(F.col("series_name"))).filter("key <> ''").groupBy("key").agg(F.max_by("series_number", "entered").alias("baseline_class"))
    names = names.drop("entered")
    fixed = last_wins(subject_series, ["subject_id"], "row_index").select("subject_id", F.col("series_number").alias("fixed_class"))
    known = last_wins(baseline.withColumn("baseline_name", text.alias(F.col("baseline_name"))), ["subject_id"], "row_index").select("subject_id", "baseline_name")
    known = known.withColumn("key", ids.canonical_key(F.col("baseline_name"))).join(reverse, "key", "left").drop("key")
    names, fixed, known = checked(names, fixed, known)
    o = overrides.filter(ids.truthy(F.col("reviewed"), on=False)).select(
        "run_date", "row_index", "asset", F.lit(True).alias("o_found"), ids.subject_id(F.col("confirmed_subject")).alias("o_subject"),
        ids.class_number(F.col("confirmed_class")).alias("o_class"), ids.strip(F.col("notes")).alias("o_notes"),
        ids.excludes_row(F.col("notes")).alias("o_exclude"), F.col("row_index").alias("o_order"),
    )
    o = last_wins(o, ["run_date", "row_index", "asset"], "o_order").drop("o_order")

    texts = [F.col("pot_tag"), F.col("notes"), F.col("caption"), F.col("ocr_excerpt")]
    rows = positions(intake, ["run_date"], [F.col("row_index")], "run_position")
    rows = rows.join(o, ["run_date", "row_index", "asset"], "left")
    rows = rows.withColumns(
        {
            "label": text.clamp_domain(F.col("label"), ["tomato", "non_tomato", "unknown"], "unknown"),
            "numbers": ids.number_candidates(F.col("notes"), F.col("caption"), F.col("ocr_excerpt")),
            "detected": F.coalesce(ids.first_subject_id(*texts), F.col("o_subject")),
            "excluded": F.coalesce("o_exclude", F.lit(False)),
        }
    )
    rows = rows.withColumn("expected", F.lit(p.expected).cast("long"))
    if p.usual_sizes:
        sizes = intake.groupBy("run_date").agg(F.count("*").alias("_size"))
        usual = F.when(F.col("_size").between(*p.usual_sizes), F.col("expected")).otherwise(F.col("_size"))
        rows = rows.join(sizes, "run_date").withColumn("expected", usual).drop("_size")
    extra = F.col("detected").isNull() & F.lit(p.sequential) & (F.col("expected") > 0) & (F.col("run_position") > F.col("expected")) & ~F.col("excluded")
    rows = rows.withColumns({"dropped": F.when(extra, "extra").when(F.col("excluded"), "excluded"), "inferred": F.col("detected").isNull() & F.lit(p.sequential)})
    live = ~F.col("dropped").eqNullSafe("extra")
    rows = rows.withColumn("log", F.array().cast(LOG))
    rows = _noted(rows, (~live, "extra_row", ["expected"]))
    rows = rows.withColumn("subject_id", F.when(F.col("inferred"), F.concat(F.col("run_position").cast("string"), F.lit("T"))).otherwise(F.col("detected")))
    number = ids.subject_number(F.col("subject_id"))
    seen = lambda n: F.coalesce(F.array_contains("numbers", n), F.lit(False))
    rows = rows.withColumn("counted_confirmation", seen(number))
    class_texts = [F.col("packet_tag"), F.col("notes"), F.col("caption"), F.col("ocr_excerpt")]
    guess = F.try_element_at(F.filter("numbers", lambda x: (x != F.coalesce(number, F.lit(-1))) & (x <= p.most_class)), F.lit(1))
    found = F.coalesce(ids.first_class_number(*class_texts), guess) if p.name_fallback else F.lit(None).cast("bigint")
    rows = rows.withColumn("found_class", found)
    if p.name_fallback:  # names of earlier runs are looked up for what follows, and these texts are read once
        rows = evidence = stored(rows, "evidence")
    rows = rows.join(fixed, "subject_id", "left").join(known, "subject_id", "left")
    use_fixed = F.col("fixed_class").isNotNull()
    after_fixed = F.coalesce("fixed_class", "found_class")
    replaced = lambda a, b: live & (F.col(a) != F.col(b))
    rows = _noted(
        rows,
        (replaced("fixed_class", "found_class"), "override_series", ["subject_id", "fixed_class", "found_class"]),
        (~use_fixed & F.lit(p.baseline_reconcile) & replaced("baseline_class", "found_class"), "baseline_series", ["baseline_class", "found_class", "subject_id"]),
    )
    use_base = ~use_fixed & F.col("baseline_class").isNotNull() & (after_fixed.isNull() | (F.lit(p.baseline_reconcile) & (after_fixed != F.col("baseline_class"))))
    rows = rows.withColumns({"use_fixed": use_fixed, "use_base_class": F.coalesce(use_base, F.lit(False))})
    rows = rows.withColumn("class_number", F.when(F.col("use_base_class"), F.col("baseline_class")).otherwise(after_fixed).cast("bigint"))
    named = lambda d, key, out: d.join(names.select(F.col("series_number").alias(key), F.col("series_name").alias(out)), key, "left")
    rows = named(rows, "class_number", "class_name")
    derived = text.alias(text.variety_name(F.col("variety_name"), F.col("species_common_name"), F.col("caption"))) if p.name_fallback else F.lit(None).cast("string")
    told = intake.select(
        F.nullif(F.regexp_extract("caption", ids.SUBJECT_PATTERNS[2], 1), F.lit("")).try_cast("bigint").alias("number"), "run_date", "row_index", "label",
        text.alias(text.variety_name(F.col("variety_name"), F.col("species_common_name"), F.col("caption"))).alias("told"),
    )
    told = told.filter("label = 'tomato' AND number IS NOT NULL AND told IS NOT NULL")

    if p.name_fallback:
        # the identity before overrides and the one after them are looked up in one index
        asked = [evidence.select(ids.subject_number(c).alias("number"), "run_date") for c in (F.col("subject_id"), F.coalesce("o_subject", "subject_id"))]
        index = told_index(asked[0].unionByName(asked[1]), told, "number", "told")

    def historical(d: DataFrame, out: str) -> DataFrame:
        if not p.name_fallback:  # names of earlier runs are looked up only then
            return d.withColumn(out, F.lit(None).cast("string"))
        return with_told(d.withColumn("number", ids.subject_number(F.col("subject_id"))), index, "number", "told", out).drop("number")

    rows = historical(rows, "history_name")
    name = F.coalesce(derived, F.col("history_name") if p.name_fallback else F.lit(None).cast("string"), F.col("class_name"))
    rows = rows.withColumn("name", name)
    changed = lambda a, b: live & _differs(F.col(a), F.col(b))
    rows = _noted(rows, (F.col("use_fixed") & changed("class_name", "name"), "override_variety", ["subject_id", "class_name", "name"]))
    name = F.when(F.col("use_fixed"), F.coalesce("class_name", "name")).otherwise(F.col("name"))
    base_name = ~F.col("use_fixed") & F.col("baseline_name").isNotNull() & (F.col("name").isNull() | (F.lit(p.baseline_reconcile) & _differs(F.col("name"), F.col("baseline_name"))))
    rows = rows.withColumn("name", name).withColumn("use_base_name", F.coalesce(base_name, F.lit(False)))
    rows = _noted(rows, (F.col("use_base_name") & changed("baseline_name", "name"), "baseline_variety", ["baseline_name", "name", "subject_id"]))
    rows = rows.withColumn("name", F.when(F.col("use_base_name"), F.col("baseline_name")).otherwise(F.col("name")))
    rows = rows.withColumn("class_name_differs", _differs(F.col("class_name"), F.col("name")))
    rows = named(rows.withColumn("o_class", F.col("o_class").cast("bigint")), "o_class", "o_name")
    rows = _noted(
        rows,
        (live & F.col("class_name_differs"), "packet_name", ["class_number", "class_name", "name"]),
        (replaced("o_subject", "subject_id"), "row_override_subject", ["o_subject", "subject_id"]),
        (replaced("o_class", "class_number"), "row_override_class", ["o_class", "class_number"]),
        (changed("o_name", "name"), "row_override_variety", ["o_name", "name"]),
        (F.col("excluded"), "excluded_row", []),
    )
    rows = rows.withColumns(
        {
            "by_row_subject": F.col("o_subject").isNotNull(),
            "by_row_class": F.col("o_class").isNotNull(),
            "subject_id": F.coalesce("o_subject", "subject_id"),
        }
    )
    rows = rows.withColumns(
        {
            "series_map": F.col("class_name").isNotNull() | F.col("o_name").isNotNull(),
            "class_number": F.coalesce("o_class", "class_number"),
            "name": F.coalesce("o_name", "name"),
        }
    )
    # names from rows or history take the place of the class's name, which is noted where it was looked up first
    rows = historical(rows, "history_final")
    confirmed = seen(ids.subject_number(F.col("subject_id")))
    target = F.lit(p.target_only_run) | (F.col("label") == "tomato") | F.col("subject_id").isNotNull()
    rows = rows.withColumns({"ocr_confirmed": confirmed, "candidate": target})
    kept = F.col("dropped").isNull() & F.col("candidate")
    rows = _noted(
        rows,
        (kept & F.col("subject_id").isNull(), "missing_pot_id", []),
        (kept & F.col("name").isNull(), "missing_variety_name", []),
    )
    # fixed values: codes of evidence, in their order
    codes = [
        (F.col("inferred"), "pot_id_inferred_from_run_sequence"),
        (F.lit(p.target_only_run) & (F.col("label") != "tomato"), "label_not_tomato_run_assumed_tomato"),
        (F.col("ocr_confirmed"), "ocr_confirms_pot_number"),
        (F.col("history_final") == F.col("name"), "variety_from_historical_pot_mapping"),
        (F.col("series_map"), "variety_from_series_number_map"),
        (F.col("use_fixed"), "series_from_manual_pot_override"),
        (F.col("use_base_class"), "series_from_baseline_pot_mapping"),
        (F.col("use_base_name"), "variety_from_baseline_pot_mapping"),
        (F.col("by_row_subject"), "pot_id_from_manual_row_override"),
        (F.col("by_row_class"), "series_from_manual_row_override"),
        (F.col("o_notes").isNotNull(), "row_override_notes_present"),
        (~F.col("candidate"), "row_not_detected_as_tomato"),
        (F.col("candidate") & F.col("subject_id").isNull(), "missing_pot_id"),
        (F.col("candidate") & F.col("name").isNull(), "missing_variety_name"),
    ]
    rows = rows.withColumn("notes_list", F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in codes))))
    has = lambda *n: F.arrays_overlap("notes_list", F.array(*(F.lit(x) for x in n)))
    review = has("row_not_detected_as_tomato", "missing_pot_id", "missing_variety_name")
    automatic = has(*(n for _, n in codes[:2]), *(n for _, n in codes[3:10]))
    status = (
        F.when(has("missing_pot_id"), "review_needed_pot_id").when(has("missing_variety_name"), "review_needed_variety")
        .when(review, "review_needed_mapping").when(automatic, "ready_auto_resolved").otherwise("ready_direct")
    )
    source = (
        F.when(review, "manual_review")
        .when(has("pot_id_from_manual_row_override", "series_from_manual_row_override"), "manual_row_override")
        .when(has("series_from_manual_pot_override"), "manual_override")
        .when(has("series_from_baseline_pot_mapping", "variety_from_baseline_pot_mapping"), "baseline_continuity")
        .when(has("variety_from_historical_pot_mapping"), "historical_continuity")
        .when(has("variety_from_series_number_map"), "series_map")
        .when(has("pot_id_inferred_from_run_sequence"), "sequence_inference")
        .otherwise("direct_detection")
    )
    rows = rows.withColumns({"final_status": status, "resolution_source": source})
    stage = F.when(F.col("final_status") == "review_needed_pot_id", "capture").when(F.col("final_status") == "review_needed_variety", "ocr")
    stage = stage.when(F.col("final_status") == "review_needed_mapping", "mapping").otherwise("none")
    day = lambda d: F.datediff(F.col("run_date"), F.lit(d).cast("date"))
    return rows.select(
        "run_date", "row_index", "asset", "run_position", "label", "subject_id", "class_number", F.col("name").alias("variety_name"), "final_status",
        stage.alias("review_stage"), "resolution_source", F.when(review, "needs_review").otherwise("ok").alias("mapping_status"),
        F.array_join("notes_list", "; ").alias("mapping_note"), "ocr_confirmed", "counted_confirmation", "inferred", "candidate", "class_name_differs", "dropped", "log",
        day(p.potting_date).alias("day_since_potting"), (day(p.day_one) + 1).alias("experiment_day"),
    )


def _listed(values: Column) -> Column:
    """Texts as a list: ['a', 'b']."""
    quoted = F.transform(values, lambda v: F.when(v.contains("'") & ~v.contains('"'), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


#: A subject's rows are put into words in blocks of 2^16 row numbers, so no task holds more of a hot subject than their text.
_BLOCK_BITS = 16


def run_messages(rows: DataFrame, overrides: DataFrame, expected: int, most_listed: int | None = None) -> DataFrame:
    """(run_date, severity, code, item, text): what the rows' logs say, and the faults of whole runs.

    rows: resolved identities. Errors are incomplete rows, subjects seen twice or with several names, and a count of subjects
    other than expected; classes with several names, rows that are not of the target and declared missing ids are warnings.
    Declared missing ids of a run's reviewed overrides lower its expected count. A subject's rows are all listed in the text,
    however many, unless most_listed asks to count longer lists.
    """
    # several views of the same rows: they are resolved once
    rows = stored(rows.select("run_date", "row_index", "subject_id", "class_number", "variety_name", "candidate", "dropped", "log"), "resolved")
    kept = rows.filter("dropped IS NULL")
    made = lambda d, severity, code, item, text: d.select("run_date", F.lit(severity).alias("severity"), F.lit(code).alias("code"), item.cast("string").alias("item"), text.alias("text"))
    own = rows.select("run_date", "row_index", F.explode("log").alias("e")).select("run_date", "row_index", "e.code", "e.values")
    worse = F.when(F.col("code").isin(*(k for k, (v, _) in ROW_TEXTS.items() if v == "error")), "error").otherwise("warning")
    own = own.select("run_date", worse.alias("severity"), "code", F.col("row_index").cast("string").alias("item"), _row_text(F.col("code"), F.col("row_index"), F.col("values")).alias("text"))

    each = kept.filter("subject_id IS NOT NULL").groupBy("run_date", "subject_id").agg(F.array_sort(F.collect_set("variety_name")).alias("names"))
    blocks = kept.filter("subject_id IS NOT NULL").groupBy("run_date", "subject_id", F.shiftright(F.col("row_index").cast("bigint"), _BLOCK_BITS).alias("block"))
    blocks = blocks.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("row_index")).cast("array<string>"), ", ").alias("part"))
    twice = blocks.groupBy("run_date", "subject_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts")).filter("n > 1")
    which = F.concat(F.lit("["), F.array_join("parts.part", ", "), F.lit("]"))
    if most_listed is not None:
        which = F.when(F.col("n") <= most_listed, which).otherwise(F.col("n").cast("string"))
    classes = kept.filter("class_number IS NOT NULL").groupBy("run_date", "class_number").agg(F.array_sort(F.collect_set("variety_name")).alias("names"))

    declared = overrides.filter(ids.truthy(F.col("reviewed"), on=False)).select("run_date", F.explode(ids.declared_missing(F.col("notes"))).alias("m"))
    declared = declared.groupBy("run_date").agg(F.array_sort(F.collect_set("m")).alias("missing"))
    runs = rows.groupBy("run_date").agg(F.count("*").alias("total"), F.count_if(F.col("candidate") & F.col("dropped").isNull()).alias("candidates"))
    runs = runs.join(each.groupBy("run_date").agg(F.count("*").alias("subjects")), "run_date", "left").join(declared, "run_date", "left")
    runs = runs.withColumn("subjects", F.coalesce("subjects", F.lit(0)))
    runs = runs.withColumn("effective", F.greatest(F.lit(expected) - F.coalesce(F.size("missing"), F.lit(0)), F.lit(0)))
    wrong = runs.filter((F.lit(expected) > 0) & (F.col("subjects") != F.col("effective")))
    count = _say(f"unique_pot_count={{}} does not match expected_effective_pots={{}} (expected_pots={expected})", "subjects", "effective")
    other = runs.filter("candidates <> total")
    parts = [
        own,
        made(twice, "error", "duplicate_subject", F.col("subject_id"), _say("pot {}: duplicate rows {}", "subject_id", which)),
        made(each.filter("size(names) > 1"), "error", "conflicting_names", F.col("subject_id"), _say("pot {}: conflicting varieties {}", "subject_id", _listed(F.col("names")))),
        made(classes.filter("size(names) > 1"), "warning", "conflicting_class_names", F.col("class_number"), _say("packet {}: conflicting varieties {}", "class_number", _listed(F.col("names")))),
        made(wrong, "error", "subject_count", F.col("subjects"), count),
        made(other, "warning", "other_rows", F.col("candidates"), _say("run contains non-tomato/unknown rows: tomato_candidates={} total_rows={}", "candidates", "total")),
        made(runs.filter("missing IS NOT NULL"), "warning", "declared_missing", F.size("missing"), _say("declared missing pots via manual row override: {}", F.array_join("missing", ", "))),
    ]
    return reduce(DataFrame.unionByName, parts)


def violations(rows: DataFrame, overrides: DataFrame, expected: int) -> DataFrame:
    """(run_date, code, item): the errors of each run; a run passes the strict gate if it has none."""
    return run_messages(rows, overrides, expected).filter("severity = 'error'").select("run_date", "code", "item")


def gate(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_date, errors, warnings, passed) of each run of runs (run_date): warnings alone do not stop a run."""
    counts = messages.groupBy("run_date").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    out = runs.select("run_date").distinct().join(counts, "run_date", "left").na.fill(0, ["errors", "warnings"])
    return out.withColumn("passed", F.col("errors") == 0)


def run_report(rows: DataFrame, expected: int) -> DataFrame:
    """One row of counters for each run."""
    kept = F.col("dropped").isNull()
    n = lambda c: F.count_if(c)
    return rows.groupBy("run_date").agg(
        F.count("*").alias("total_rows"), n(kept).alias("kept_rows"), n(F.col("dropped") == "extra").alias("skipped_rows"), n(F.col("dropped") == "excluded").alias("excluded_rows"),
        n(F.col("inferred") & ~F.col("dropped").eqNullSafe("extra")).alias("inferred_rows"), n(F.col("counted_confirmation") & ~F.col("dropped").eqNullSafe("extra")).alias("confirmed_rows"),
        F.count_distinct(F.when(kept, F.col("subject_id"))).alias("subjects"), n(kept & (F.col("final_status") == "ready_direct")).alias("ready_direct"),
        n(kept & (F.col("final_status") == "ready_auto_resolved")).alias("ready_auto"), n(kept & F.col("final_status").startswith("review_needed")).alias("review_needed"),
        F.least(F.count("*"), F.lit(expected)).alias("expected_rows"),
    )


def run_counts(rows: DataFrame) -> DataFrame:
    """(run_date, kind, value, n): the kept rows of each run by label, final status, review stage and source."""
    kinds = ("label", "final_status", "review_stage", "resolution_source")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds)))
    return rows.filter("dropped IS NULL").select("run_date", each.alias("e")).groupBy("run_date", "e.kind", "e.value").agg(F.count("*").alias("n"))


def bad_rows(rows: DataFrame) -> DataFrame:
    """(run_date, row_index): kept rows whose mapping lacks a subject."""
    lacks = (F.col("mapping_status") != "ok") & F.col("mapping_note").contains("missing_pot_id")
    return rows.filter(F.col("dropped").isNull() & lacks).select("run_date", "row_index")


def with_phases(rows: DataFrame, phases: DataFrame, stage: str) -> DataFrame:
    """rows with lifecycle_stage and the phase that holds their run; a run without a phase has nulls."""
    return phase_of(rows.withColumn("lifecycle_stage", F.lit(stage)), phases, F.lit(stage))
