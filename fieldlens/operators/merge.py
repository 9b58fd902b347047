"""Keyed upserts, snapshot differences and other set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, incoming: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """base with the incoming rows, the last one of a key, in the place of base's; columns in keep stay base's own."""
    rest = [c for c in base.columns if c not in keys]
    a = base.select(*keys, F.struct(F.lit(0).alias("s"), F.lit(None).cast(incoming.schema[order].dataType).alias("o")).alias("_o"), F.struct(*rest).alias("_row"), F.struct(*rest).alias("_old"))
    b = incoming.select(*keys, F.struct(F.lit(1).alias("s"), F.col(order).alias("o")).alias("_o"), F.struct(*rest).alias("_row"))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*keys).agg(F.max_by("_row", "_o").alias("_row"), F.max("_old").alias("_old"))
    pick = lambda c: F.coalesce(F.col(f"_old.{c}"), F.col(f"_row.{c}")) if c in keep else F.col(f"_row.{c}")
    return both.select(*keys, *(pick(c).alias(c) for c in rest))


def upsert_counts(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """(inserted, updated, output): a key that is new is inserted once, all other incoming rows update."""
    known = base.select(*keys).distinct().withColumn("_b", F.lit(1))
    per = incoming.groupBy(*keys).agg(F.count("*").alias("_n"))
    j = per.join(known, keys, "full")
    return j.agg(
        F.count_if(F.col("_b").isNull()).alias("inserted"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count_if(F.col("_b").isNull())).alias("updated"),
        F.count("*").alias("output"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, day: str) -> DataFrame:
    """Per day: rows, assets added, removed and added *forward* (not before the old snapshot's last day)."""
    last = old.agg(F.max(day).alias("_last"))
    o = old.groupBy(F.col(key).alias("_k")).agg(F.max(day).alias("_od"))
    n = new.groupBy(F.col(key).alias("_k")).agg(F.max(day).alias("_nd"), F.count("*").alias("_rows"))
    j = o.join(n, "_k", "full").join(F.broadcast(last), F.lit(True), "left")
    added, removed = F.col("_od").isNull(), F.col("_nd").isNull()
    return j.groupBy(F.coalesce("_nd", "_od").alias(day)).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.count_if(added).alias("added"),
        F.count_if(removed).alias("removed"),
        F.count_if(added & (F.col("_last").isNull() | (F.col("_nd") >= F.col("_last")))).alias("forward"),
    )


def first_of_each(frames: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union where the first row of a key (by frame, then order) stays; rows without a key all stay."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_f", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    cols = [c for c in out.columns if c != "_f"]
    keyed = out.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in cols if c != key]), F.struct("_f", order)).alias("_r"))
    keyed = keyed.select(*(F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in cols))
    return keyed.unionByName(out.filter(F.col(key).isNull()).select(*cols))


def missing_of_spine(present: DataFrame, column: str, n: int) -> DataFrame:
    """1..n without the numbers present."""
    spine = present.sparkSession.range(1, n + 1).select(F.col("id").alias(column))
    return spine.join(present.select(F.col(column).cast("bigint").alias(column)).distinct(), column, "left_anti")


def unmapped(rows: DataFrame, mapped: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(mapped, keys, "left_anti")


def backfilled(queue: DataFrame, review: DataFrame, labeled: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The review rows with a value from review, else queue, else labeled."""
    col = lambda d, n: d.select(*keys, F.col(column).alias(n))
    return col(review, "_r").join(col(queue, "_q"), keys, "left").join(col(labeled, "_l"), keys, "left").select(*keys, F.coalesce("_r", "_q", "_l").alias(column))


def pre_boundary(labeled: DataFrame, review: DataFrame, index: str) -> DataFrame:
    """Labeled rows before the least review index, to be excluded."""
    least = review.agg(F.min(index).alias("_m"))
    return labeled.join(F.broadcast(least), F.col(index) < F.col("_m")).drop("_m").withColumn("exclude_row", F.lit(True))


def content_hash(df: DataFrame, but: tuple[str, ...] = ()) -> DataFrame:
    """One row (rows, hash) that says whether a table's content, but for some columns, is the same; order does not count."""
    cols = sorted(c for c in df.columns if c not in but)
    h = F.xxhash64(*cols).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("hash"))


def refreshed(triage: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """triage with the batch's values where it has the key."""
    b = batch.select(key, *(F.col(c).alias(f"_b_{c}") for c in columns))
    return triage.join(b, key, "left").select(*(F.coalesce(f"_b_{c}", c).alias(c) if c in columns else F.col(c) for c in triage.columns))


def refresh_problems(triage: DataFrame, batch: DataFrame, key: str, expected: int) -> DataFrame:
    """(code, item): `batch_size` if the batch has not as many rows as expected, and each key of triage that it lacks."""
    size = batch.agg(F.count("*").alias("n")).filter(F.col("n") != expected).select(F.lit("batch_size").alias("code"), F.col("n").cast("string").alias("item"))
    lacking = triage.dropna(subset=[key]).join(batch.select(key), key, "left_anti")
    return size.unionByName(lacking.select(F.lit("missing_in_batch").alias("code"), F.col(key).cast("string").alias("item")))
