"""A monitor of manifests: each run is compared with what the run before it has kept, and keeps its own.

`root`/state/run=<n> holds the assets of a run, `root`/changes/run=<n> what came and went, and `root`/history/run=<n>, written
last, the run's one row. A run counts once that row is whole: one that failed is run again as if it had never been, and
one that is repeated does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keyed import _fs

ASSET = "asset_id string, capture_date string, captured_at string, photo_index string"
CHANGE = "change string, asset_id string, capture_date string, captured_at string, photo_index string, forward boolean"
COUNTS = "total_assets long, unique_dates long, latest_capture_date string, comparison_latest_capture_date string, added_count long, removed_count long, forward_added_count long, forward_removed_count long"
HISTORY = f"comparison_source string, {COUNTS}"


def runs(spark: SparkSession, root: str) -> list[int]:
    """The whole runs, in order."""
    fs, path = _fs(spark, f"{root}/history")
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName().removeprefix("run=")) for p in names if fs.exists(_fs(spark, f"{p.toString()}/_SUCCESS")[1]))


def _clean(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def assets(manifest: DataFrame) -> DataFrame:
    """The last row, by row_index, of each asset; rows without an id fall away, nulls are empty texts."""
    rows = manifest.select(*(_clean(c).alias(c) for c in ("asset_id", "capture_date", "captured_at", "photo_index")), "row_index").filter("asset_id <> ''")
    last = rows.groupBy("asset_id").agg(F.max_by(F.struct("capture_date", "captured_at", "photo_index"), "row_index").alias("r"))
    return last.select("asset_id", "r.*")


def date_counts(manifest: DataFrame) -> DataFrame:
    """(capture_date, n): rows of each date, repeated assets included."""
    return manifest.filter(_clean("asset_id") != "").groupBy(_clean("capture_date").alias("capture_date")).agg(F.count("*").alias("n"))


def changes(current: DataFrame, previous: DataFrame, latest: str) -> DataFrame:
    """Assets added since previous and removed from it; forward ones are of its latest date or later (all if it has none)."""
    both = current.select("asset_id", F.struct(*current.columns).alias("c")).join(previous.select("asset_id", F.struct(*previous.columns).alias("p")), "asset_id", "full")
    row, gone = F.coalesce("c", "p"), F.col("c").isNull()
    out = both.filter(gone | F.col("p").isNull()).select(F.when(gone, "removed").otherwise("added").alias("change"), row.alias("r"))
    return out.select("change", "r.*").withColumn("forward", F.lit(not latest) | (F.col("capture_date") >= latest))


def observe(manifest: DataFrame, root: str, run: int, compare: DataFrame | None = None) -> DataFrame:
    """Makes a run of the manifest (asset_id, capture_date, captured_at, photo_index, row_index) and returns its history row.

    It is compared with the manifest `compare`, or else with the last run before it, or with nothing. Runs may not go back.
    """
    spark = manifest.sparkSession
    done = runs(spark, root)
    if run in done:
        return spark.read.schema(HISTORY).parquet(f"{root}/history/run={run}")
    if done and run < done[-1]:
        raise ValueError(f"run {run} comes after run {done[-1]}")
    assets(manifest).write.mode("overwrite").parquet(f"{root}/state/run={run}")
    current = spark.read.schema(ASSET).parquet(f"{root}/state/run={run}")
    if compare is not None:
        previous, source = assets(compare), "manifest"
    elif done:
        previous, source = spark.read.schema(ASSET).parquet(f"{root}/state/run={done[-1]}"), f"run {done[-1]}"
    else:
        previous, source = spark.createDataFrame([], ASSET), "none"
    top = lambda t: t.agg(F.coalesce(F.max("capture_date"), F.lit("")).alias("d")).first()["d"]
    before = top(previous)
    changes(current, previous, before).write.mode("overwrite").parquet(f"{root}/changes/run={run}")
    moved = spark.read.schema(CHANGE).parquet(f"{root}/changes/run={run}")
    many = lambda kind, forward: F.count_if((F.col("change") == kind) & (F.col("forward") | F.lit(not forward)))
    counts = moved.agg(*(many(k, f).alias(f"{'forward_' if f else ''}{k}_count") for f in (False, True) for k in ("added", "removed")))
    whole = current.agg(F.count("*").alias("total_assets"), F.coalesce(F.max("capture_date"), F.lit("")).alias("latest_capture_date"))
    dates = date_counts(manifest).agg(F.count("*").alias("unique_dates"))
    row = whole.join(dates, F.lit(True)).join(counts, F.lit(True)).withColumns({"comparison_source": F.lit(source), "comparison_latest_capture_date": F.lit(before)})
    row.select(*(c.split()[0] for c in HISTORY.split(", "))).write.mode("overwrite").parquet(f"{root}/history/run={run}")
    return spark.read.schema(HISTORY).parquet(f"{root}/history/run={run}")


def history(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all whole runs, with their number `run`; no runs give no rows."""
    found = runs(spark, root)
    if not found:
        return spark.createDataFrame([], f"{HISTORY}, run int")
    paths = [f"{root}/history/run={n}" for n in found]
    return spark.read.schema(f"{HISTORY}, run int").option("basePath", f"{root}/history").parquet(*paths)


def moves_by_date(spark: SparkSession, root: str, run: int) -> DataFrame:
    """(change, capture_date, n) of a run."""
    return spark.read.schema(CHANGE).parquet(f"{root}/changes/run={run}").groupBy("change", "capture_date").agg(F.count("*").alias("n"))
