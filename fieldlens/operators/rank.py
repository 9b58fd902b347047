"""Latest rows, ranks and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The row of each key that is greatest in order."""
    rest = [c for c in rows.columns if c != key]
    return rows.dropna(subset=[key]).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def latest_per_subject(rows: DataFrame, numeric: bool = False) -> DataFrame:
    """(subject_id, run_date, captured_at, row_index, asset): the last row of the subject's last run; row_index compares as text unless numeric."""
    index = F.col("row_index") if numeric else F.col("row_index").cast("string")
    return latest(rows.select("subject_id", "run_date", "captured_at", "row_index", "asset"), "subject_id", [F.col("run_date"), F.col("captured_at"), index, F.col("asset")])


def export_counts(rows: DataFrame, key: str, saved: str) -> DataFrame:
    """Latest export and number of exports of each task."""
    return rows.dropna(subset=[key]).groupBy(key).agg(F.max(saved).alias("latest"), F.count("*").alias("exports"))


#: Bits of monotonically_increasing_id() below the partition's number.
_ROW_BITS = 33


def in_order(rows: DataFrame, groups: list[str], order: list[Column], name: str = "ordered") -> DataFrame:
    """rows, stored once in the order of groups and order, with `_p` (the part) and `_i` (a number that grows in that order).

    Spark deals the rows by ranges of all sort keys, so a group with most of the rows goes to many parts; how many follows
    from the shuffle partitions and the bytes in them. Whatever reads the result finds the same parts.
    """
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)] + [c.alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_g{i}" for i in range(len(groups))] + [f"_o{i}" for i in range(len(order))]
    dealt = rows.select("*", *keys).repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    return stored(dealt.withColumn("_i", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_i", _ROW_BITS)), name)


def _same(groups: list[str]) -> Column:
    """The join condition of a part's rows with what is carried into it."""
    on = F.col("_p") == F.col("_q")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return on


def _parts(dealt: DataFrame, groups: list[str], totals: list[Column]) -> DataFrame:
    """One row for each part of each group: `_q`, `_g0`... and the totals."""
    out = dealt.groupBy("_p", *groups).agg(*totals)
    return out.withColumnsRenamed({"_p": "_q"} | {g: f"_g{i}" for i, g in enumerate(groups)})


def _before(groups: list[str]) -> Window:
    return Window.partitionBy(*(f"_g{i}" for i in range(len(groups)))).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rank from 1 over the whole table without one task that sorts all of it. The order must be total for a stable rank."""
    return positions(rows, [], order, name)


def positions(rows: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """The place of each row, from 1, in its group by order; a group with most of the rows is sorted in many parts.

    Null groups are a group. A part's first number and the counts of the parts before it give the place, so no row is
    compared or sorted again. Those are as many as groups and parts at most, and stored, so Spark knows their size.
    """
    dealt = in_order(rows, groups, order)
    counts = _parts(dealt, groups, [F.min("_i").alias("_first"), F.count("*").alias("_n")])
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(_before(groups)), F.lit(0)) - F.col("_first") + 1).drop("_first", "_n")
    out = dealt.join(stored(offsets, "offsets"), _same(groups)).withColumn(name, F.col("_i") + F.col("_off"))
    return out.drop("_i", "_p", "_q", "_off", *(f"_g{i}" for i in range(len(groups))))


def running(rows: DataFrame, groups: list[str], order: list[Column], values: dict[str, tuple[str, Column]], current: bool = True) -> DataFrame:
    """rows with running values of their group by order: name -> (kind, column), kind sum, min, max or last (not null).

    Each part of a group keeps its own running values, and the totals of the parts before are carried into it, so a group
    with most of the rows is many tasks' work. current: whether a row's own value counts. Null groups are a group; without
    a value so far the result is null.
    """
    kinds = {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    names = list(values)
    dealt = in_order(rows.withColumns({f"_v{i}": values[n][1] for i, n in enumerate(names)}), groups, order)
    within = Window.partitionBy("_p", *groups).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    total = lambda i, n: F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col("_i"))) if values[n][0] == "last" else kinds[values[n][0]](f"_v{i}")
    parts = _parts(dealt, groups, [total(i, n).alias(f"_t{i}") for i, n in enumerate(names)])
    parts = parts.withColumns({f"_c{i}": kinds[values[n][0]](f"_t{i}").over(_before(groups)) for i, n in enumerate(names)}).drop(*(f"_t{i}" for i in range(len(names))))
    out = dealt.withColumns({f"_w{i}": kinds[values[n][0]](f"_v{i}").over(within) for i, n in enumerate(names)})
    out = out.join(stored(parts, "carried"), _same(groups))

    def joined(i: int, kind: str) -> Column:
        own, carried = F.col(f"_w{i}"), F.col(f"_c{i}")
        if kind == "sum":
            return F.when(own.isNull(), carried).when(carried.isNull(), own).otherwise(own + carried)
        return F.coalesce(own, carried) if kind == "last" else {"min": F.least, "max": F.greatest}[kind](own, carried)

    out = out.withColumns({n: joined(i, values[n][0]) for i, n in enumerate(names)})
    gone = [f"_{k}{i}" for k in "vwc" for i in range(len(names))]
    return out.drop("_i", "_p", "_q", *gone, *(f"_g{i}" for i in range(len(groups))))


def label_queue_order(readiness: Column, focus: Column, spill: Column, neighbor: Column, cov: Column, number: Column, subject: Column) -> list[Column]:
    tier = F.when(readiness == "high", 0).when(readiness == "moderate", 1).otherwise(2)
    return [tier, -focus, F.coalesce(spill, F.when(neighbor > 0, neighbor), F.lit(1.0)), -cov, number, subject]


def top_k(rows: DataFrame, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows with their rank; only k rows reach the window."""
    return rows.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def natural(c: Column) -> list[Column]:
    """Number first, then text; ids without a number last."""
    return [F.coalesce(F.regexp_extract(c, "^([0-9]+)", 1).try_cast("bigint"), F.lit(1 << 60)), c]


def timeline(rows: DataFrame, n: int) -> DataFrame:
    """(subject_number, runs, cells): each of 1..n with its last variety per run as an array of structs by run."""
    cells = rows.groupBy("subject_number", "run_date").agg(F.max_by("variety_name", "row_index").alias("variety_name"))
    arr = cells.groupBy("subject_number").agg(F.count("*").alias("runs"), F.array_sort(F.collect_list(F.struct("run_date", "variety_name"))).alias("cells"))
    spine = rows.sparkSession.range(1, n + 1).select(F.col("id").alias("subject_number"))
    return spine.join(arr, "subject_number", "left").select("subject_number", F.coalesce("runs", F.lit(0)).alias("runs"), "cells")


STATUS_ORDER = ("risk", "drift", "info", "warn", "ok")
TIER_ORDER = ("ocr_match", "weak_ocr", "no_signal")
PRIORITY_ORDER = ("high", "medium", "low")
INGEST_ORDER = ("ready", "missing_required_labels", "identity_mismatch", "missing_image", "missing_export", "invalid_export", "started_empty", "pending")


def place_in(c: Column, order: tuple[str, ...], other: int = 99) -> Column:
    """The place of a value in a list of words, `other` for any other."""
    place = F.array_position(F.array(*(F.lit(v) for v in order)), F.trim(c))
    return F.coalesce(F.nullif(place, F.lit(0)) - 1, F.lit(other))


def card_order(status: Column, warnings: Column, subject: Column) -> list[Column]:
    return [place_in(status, STATUS_ORDER), -F.coalesce(warnings, F.lit(0)), *natural(subject)]


def reviewer_order(tier: Column, run_date: Column, row_index: Column) -> list[Column]:
    return [place_in(tier, TIER_ORDER), run_date, row_index]


def task_order(status: Column, rank: Column, subject: Column) -> list[Column]:
    """Ready tasks first; tasks without a rank come last of their status."""
    return [place_in(status, INGEST_ORDER), F.coalesce(rank, F.lit(10_000)), F.upper(F.trim(subject))]


def watchlist_order(priority: Column, subject: Column) -> list[Column]:
    return [place_in(priority, PRIORITY_ORDER, 3), *natural(subject)]


def top_patterns(patterns: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent texts with their counts; ties by text."""
    counts = patterns.dropna(subset=[column]).groupBy(F.col(column).alias("pattern")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "pattern").limit(k)
