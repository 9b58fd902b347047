"""Dimension lookups, interval and before-date joins, comparison over a spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import intervals


def last_wins(df: DataFrame, keys: list[str], order: str, first: bool = False) -> DataFrame:
    """One row a key: the one of the greatest (or least) order; rows with a null key fall away."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.min_by if first else F.max_by)(F.struct(*rest), F.col(order))
    out = df.dropna(subset=keys).groupBy(*keys).agg(pick.alias("_row"))
    return out.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def layered(base: DataFrame, over: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Full outer join where the second map's values win."""
    right = over.select(key, *(F.col(v).alias(f"_o_{v}") for v in values))
    return base.select(key, *values).join(right, key, "full").select(key, *(F.coalesce(f"_o_{v}", v).alias(v) for v in values))


def overlay(base: DataFrame, over: DataFrame, key: str, asset: str, fields: list[str]) -> DataFrame:
    """Override values where they are not empty, unless the override names another asset; `applied` tells."""
    right = over.select(key, F.col(asset).alias("_asset"), F.lit(True).alias("_found"), *(F.col(f).alias(f"_o_{f}") for f in fields))
    same = F.col("_found") & (F.col("_asset").isNull() | (F.col("_asset") == "") | (F.col("_asset") == F.col(asset)))
    joined = base.join(right, key, "left").withColumn("applied", F.coalesce(same, F.lit(False)))
    values = {f: F.when(F.col("applied"), F.coalesce(F.nullif(F.col(f"_o_{f}"), F.lit("")), F.col(f))).otherwise(F.col(f)) for f in fields}
    return joined.withColumns(values).withColumn("mismatch", F.coalesce(F.col("_found") & ~F.col("applied"), F.lit(False))).drop("_asset", "_found", *(f"_o_{f}" for f in fields))


def phase_of(runs: DataFrame, phases: DataFrame, stage: Column) -> DataFrame:
    """Each run with the first phase (by priority) whose closed interval holds it and whose stage agrees or is empty.

    phases: (phase_id, phase_name, lifecycle_stage, start_date, end_date, start_label, end_label, priority), any number of
    them, overlapping or not; stage is a literal. Runs without a phase keep nulls.
    """
    own = F.col("lifecycle_stage")
    agrees = own.isNull() | (own == "") | stage.isNull() | (own == stage)
    names = ["phase_id", "phase_name", "start_date", "end_date", "start_label", "end_label"]
    best = intervals.first_holding(runs, "run_date", phases.filter(agrees), "start_date", "end_date", ["priority", "phase_id"], names)
    best = best.withColumnRenamed("found", "p")
    edge = F.when(F.col("run_date") == F.col("p.start_date"), "phase_start").when(F.col("run_date") == F.col("p.end_date"), "phase_end").otherwise("phase_window")
    label = (
        F.when(F.col("run_date") == F.col("p.start_date"), F.coalesce("p.start_label", F.lit("Phase Start")))
        .when(F.col("run_date") == F.col("p.end_date"), F.coalesce("p.end_label", F.lit("Phase End")))
    )
    best = best.select("run_date", F.col("p.phase_id").alias("phase_id"), F.col("p.phase_name").alias("phase_name"), edge.alias("phase_boundary"), label.alias("phase_day_label"))
    return runs.join(best, "run_date", "left")


def history(rows: DataFrame, subject: str, value: str) -> DataFrame:
    """rows with `historical`: the subject's last value of a strictly earlier run; row_index decides within a run.

    Values are carried from run to run in order, part by part of a subject with many runs.
    """
    from .rank import running

    per_run = rows.groupBy(subject, "run_date").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("row_index"))).alias("_v"))
    runs = running(per_run, [subject], [F.col("run_date")], {"historical": ("last", F.col("_v"))}, current=False).drop("_v")
    runs = runs.withColumnsRenamed({subject: "_subject", "run_date": "_run"})
    return rows.join(runs, (F.col(subject) == F.col("_subject")) & (F.col("run_date") == F.col("_run")), "left").drop("_subject", "_run")


def told_index(asked: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """(key, run_date, value) for those asked (key, run_date) that have one: of all known (key, run_date, row_index, value) of
    strictly earlier runs, the value with the greatest row_index. Stored, so that several lookups order the runs once."""
    from .rank import running

    last = known.groupBy(key, "run_date").agg(F.max(F.struct("row_index", F.col(value).alias("v"))).alias("_k"))
    asked = asked.select(key, "run_date").dropna().distinct().join(last, [key, "run_date"], "full")
    carried = running(asked, [key], [F.col("run_date")], {"_best": ("max", F.col("_k"))}, current=False)
    return stored(carried.filter("_best IS NOT NULL").select(key, "run_date", F.col("_best.v").alias(value)), "told")


def with_told(rows: DataFrame, index: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """rows (key, run_date) with `out`, the value of told_index."""
    index = index.select(F.col(key).alias("_key"), F.col("run_date").alias("_run"), F.col(value).alias(out))
    return rows.join(index, (F.col(key) == F.col("_key")) & (F.col("run_date") == F.col("_run")), "left").drop("_key", "_run")


def told_before(rows: DataFrame, known: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """rows (key, run_date) with `out`: of all known (key, run_date, row_index, value) of strictly earlier runs, the value with
    the greatest row_index. Runs are few beside rows: both sides are brought to one row a run before they are put in order."""
    return with_told(rows, told_index(rows, known, key, value), key, value, out)


def earliest(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The row of the least capture_date of each key, ties by row_index."""
    first = F.min_by(F.struct("capture_date", *values), F.struct("capture_date", "row_index"))
    return rows.dropna(subset=[key, "capture_date"]).groupBy(key).agg(first.alias("b")).select(key, *(F.col(f"b.{v}").alias(f"base_{v}") for v in ["capture_date", *values]))


#: Sources that carry a name on rather than see it.
CONTINUITY = ("baseline_continuity", "historical_continuity", "series_map", "sequence_inference", "manual_override")


def compare_runs(a: DataFrame, b: DataFrame, spine: DataFrame) -> DataFrame:
    """subject_id with variety_a/b and status of two runs: (subject_id, variety_name, resolution_source, ocr_confirmed)."""
    side = lambda d, s: d.select("subject_id", F.lit(True).alias(f"has_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("variety_name", "resolution_source", "ocr_confirmed")))
    both = spine.join(side(a, "a"), "subject_id", "left").join(side(b, "b"), "subject_id", "left")
    ca, cb = (F.coalesce(F.col(f"resolution_source_{s}").isin(*CONTINUITY), F.lit(False)) for s in "ab")
    oa, ob = (F.coalesce(F.col(f"ocr_confirmed_{s}"), F.lit(False)) for s in "ab")
    status = (
        F.when(F.col("has_a").isNull() | F.col("has_b").isNull(), "warn")
        .when(F.col("variety_name_a") != F.col("variety_name_b"), "drift")
        .when(ca & cb & ~oa & ~ob, "risk")
        .when(oa & ob, "ok")
        .otherwise("info")
    )
    variety = F.coalesce("variety_name_b", "variety_name_a", F.lit("unknown"))
    return both.select("subject_id", "variety_name_a", "variety_name_b", variety.alias("variety_name"), status.alias("status"))


def keys_of_registry(registry: DataFrame) -> DataFrame:
    """(key, id): id, name, and id with spaces, each as slug; the first entry of a key wins."""
    from ..functions.ids import slug

    keys = registry.select("id", "row_index", F.posexplode(F.array(slug(F.col("id")), slug(F.col("name")), slug(F.regexp_replace("id", "_", " ")))).alias("p", "key"))
    return keys.groupBy("key").agg(F.min_by("id", F.struct("row_index", "p")).alias("id"))


def run_pair(dates: list, first=None, second=None, preferred: tuple | None = None) -> tuple:
    """Two runs to compare: both given, else the preferred pair if it exists, else the last two; one given takes its
    neighbour. dates is the short list of distinct runs."""
    days = sorted(set(dates))
    if first is not None and second is not None:
        return first, second
    if first is None and second is None:
        if preferred and all(p in days for p in preferred):
            return preferred
        return (days[-2], days[-1]) if len(days) > 1 else (None, days[-1] if days else None)
    given = first if first is not None else second
    others = [d for d in days if d != given]
    if first is not None:
        later = [d for d in others if d > given]
        return given, later[0] if later else (others[-1] if others else None)
    earlier = [d for d in others if d < given]
    return earlier[-1] if earlier else (others[0] if others else None), given
