"""Which rows a step works on: runs, ranges, labels, queues, fetch and image work-lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, text
from ..sources.shared import checked


def of_run(rows: DataFrame, run: str | None = None, date: str = "run_date") -> DataFrame:
    """The rows of the requested run, else of the last one; rows without a date belong to none."""
    if run is not None:
        return rows.filter(F.col(date) == F.lit(run).cast(rows.schema[date].dataType))
    last = rows.agg(F.max(date).alias("_last"))
    return rows.join(F.broadcast(last), F.col(date) == F.col("_last")).drop("_last")


def of_label(rows: DataFrame, label: str) -> DataFrame:
    return rows.filter(F.lower(F.trim("label")) == label)


def of_range(rows: DataFrame, run, first: int, last: int) -> DataFrame:
    """The rows of a run whose row_index lies between first and last, both included."""
    return rows.filter((F.col("run_date") == F.lit(run)) & F.col("row_index").between(first, last))


def routed(rows: DataFrame, step: str) -> DataFrame:
    """The rows with a subject that a next step asks for."""
    return rows.filter((F.trim("next_step") == step) & ids.strip(F.col("subject_id")).isNotNull())


def of_interest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `skip`: whether the row is about the target species, by its label, or by its caption unless the label
    says that it is not. Labels outside the known ones count as unknown."""
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    return rows.withColumn("skip", (label == "tomato") | ((label != "non_tomato") & text.is_subject_of_interest(F.col("caption"), keys)))


def skip_counts(rows: DataFrame) -> DataFrame:
    """(kept, skipped) of of_interest."""
    return rows.agg(F.count_if(~F.col("skip")).alias("kept"), F.count_if("skip").alias("skipped"))


def work_state(rows: DataFrame, present: DataFrame) -> DataFrame:
    """rows with `state`: `missing` without asset or url, `present` if the listing has (row_index, asset), else `fetch`.

    A row counts once, however often the listing names it.
    """
    there = present.select("row_index", "asset").distinct().withColumn("_there", F.lit(True))
    joined = rows.join(there, ["row_index", "asset"], "left")
    state = F.when(ids.strip(F.col("asset")).isNull() | ids.strip(F.col("photo_url")).isNull(), "missing").when(F.col("_there"), "present").otherwise("fetch")
    return joined.withColumn("state", state).drop("_there")


def latest_images(rows: DataFrame, images: DataFrame, k: int = 0) -> DataFrame:
    """The last run's rows whose image is listed, by row_index; the first k of them if k > 0."""
    some = of_run(rows).join(images.select("row_index", "asset").distinct(), ["row_index", "asset"], "left_semi").orderBy("row_index", "asset")
    return some.limit(k) if k > 0 else some


def focus_rows(resolved: DataFrame, images: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Resolved rows, of the given runs, with a subject, a place in the table, an asset and a listed image."""
    rows = resolved.filter(F.col("dropped").isNull() & (ids.subject_number(F.col("subject_id")) > 0) & (F.col("row_index") > 0) & ids.strip(F.col("asset")).isNotNull())
    if runs is not None:
        rows = rows.join(*checked(runs.select("run_date").distinct()), "run_date", "left_semi")
    return rows.join(images.select("row_index", "asset").distinct(), ["row_index", "asset"], "left_semi")


def photo_set(resolved: DataFrame, first, second) -> DataFrame:
    """The kept rows of two runs with a key `run::row::asset`."""
    rows = resolved.filter(F.col("dropped").isNull() & F.col("run_date").isin(first, second))
    return rows.withColumn("photo_key", F.concat_ws("::", F.col("run_date").cast("string"), F.col("row_index").cast("string"), "asset"))


def enriched(rows: DataFrame, profiles: DataFrame, aliases: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """rows with a profile's values in the place of their own; own values stay where the profile has none.

    profiles: (key, columns); aliases: (key, profile_key), keys being names in lower case with single spaces.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(name), F.lit(""))), r"\s+", " "))
    a = aliases.select(F.col("key").alias("_a"), "profile_key")
    a, p = checked(a, profiles.select(F.col("key").alias("_p"), *(F.col(c).alias(f"_p_{c}") for c in columns)))
    out = rows.withColumn("_key", plain).join(a, F.col("_key") == F.col("_a"), "left")
    out = out.withColumn("_key", F.coalesce("profile_key", "_key")).join(p, F.col("_key") == F.col("_p"), "left")
    value: dict[str, Column] = {c: F.coalesce(ids.strip(F.col(f"_p_{c}")), ids.strip(F.col(c))) for c in columns}
    return out.withColumns(value).drop("_key", "_a", "_p", "profile_key", *(f"_p_{c}" for c in columns))
