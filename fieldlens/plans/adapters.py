"""The driver's tables in the shape of intake, boxes, metrics and logs; SQL twins of the same text for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


INTAKE = """intake AS (SELECT event_id + 1 AS row_index, CAST(ts AS DATE) AS run_date, concat('asset_', CAST(event_id AS VARCHAR)) AS asset,
  CASE event_type WHEN 'view' THEN 'tomato' WHEN 'error' THEN 'non_tomato' ELSE 'other' END AS label,
  CASE WHEN event_id % 3 <> 0 THEN concat('seen; pot_tag=', CAST(user_id % 40 AS VARCHAR), 'T') ELSE '' END AS notes,
  CASE WHEN event_id % 5 = 0 THEN concat('Plant ', CAST(user_id % 40 AS VARCHAR), ' | p1 | phone') ELSE '' END AS caption,
  concat('no ', CAST(user_id % 40 AS VARCHAR), ' of ', CAST(event_id % 90 AS VARCHAR)) AS ocr_excerpt, value, user_id, event_id FROM events)"""


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    text = F.col("event_id").cast("string")
    subject = (F.col("user_id") % 40).cast("string")
    return e.select(
        (F.col("event_id") + 1).alias("row_index"), F.to_date("ts").alias("run_date"), F.concat(F.lit("asset_"), text).alias("asset"),
        F.when(F.col("event_type") == "view", "tomato").when(F.col("event_type") == "error", "non_tomato").otherwise("other").alias("label"),
        F.lit(None).cast("string").alias("pot_tag"), F.lit(None).cast("string").alias("packet_tag"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("seen; pot_tag="), subject, F.lit("T"))).otherwise("").alias("notes"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Plant "), subject, F.lit(" | p1 | phone"))).otherwise("").alias("caption"),
        F.concat(F.lit("no "), subject, F.lit(" of "), (F.col("event_id") % 90).cast("string")).alias("ocr_excerpt"),
        F.lit(None).cast("string").alias("variety_name"), F.lit(None).cast("string").alias("species_common_name"), "value", "user_id", "event_id",
    )


DIMS = """series AS (SELECT n_nationkey + 1 AS series_number, n_name AS series_name FROM nation),
fixed AS (SELECT concat(CAST(n_nationkey + 1 AS VARCHAR), 'T') AS subject_id, n_nationkey % 7 + 1 AS fixed_class FROM nation WHERE n_nationkey < 10),
base AS (SELECT concat(CAST(n_nationkey + 11 AS VARCHAR), 'T') AS subject_id, n_name AS baseline_name, n_nationkey + 1 AS baseline_class FROM nation WHERE n_nationkey < 20)"""


def dims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").withColumn("row_index", F.col("n_nationkey").cast("long"))
    key = F.col("n_nationkey").cast("long")
    series = n.select((key + 1).alias("series_number"), F.col("n_name").alias("series_name"), "row_index")
    fixed = n.filter("n_nationkey < 10").select(F.concat((key + 1).cast("string"), F.lit("T")).alias("subject_id"), (key % 7 + 1).alias("series_number"), "row_index")
    base = n.filter("n_nationkey < 20").select(F.concat((key + 11).cast("string"), F.lit("T")).alias("subject_id"), F.col("n_name").alias("baseline_name"), "row_index")
    return series, fixed, base


OVERRIDES = """overrides AS (SELECT run_date, row_index, asset, concat(CAST(event_id % 32 + 1 AS VARCHAR), 'T') AS o_subject, event_id % 20 + 1 AS o_class,
  event_id % 100 = 7 AS o_exclude FROM intake WHERE event_id % 50 = 7 AND event_id % 4 <> 1)"""


def overrides(rows: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return rows.filter(e % 50 == 7).select(
        "run_date", "row_index", "asset", F.concat((e % 32 + 1).cast("string"), F.lit("t")).alias("confirmed_subject"), (e % 20 + 1).cast("string").alias("confirmed_class"),
        F.when(e % 100 == 7, F.concat(F.lit("exclude_row=1; missing_pots: "), (e % 30 + 1).cast("string"), F.lit("T"))).otherwise("checked").alias("notes"),
        F.when(e % 4 == 1, "no").otherwise("yes").alias("reviewed"),
    )


METRICS = """metrics AS (SELECT p_partkey AS part, avg(l_discount) * 1.0 AS coverage, avg(l_tax) * 5 AS chlorosis, avg(l_quantity) / 50 AS focus, avg(l_discount) * 4 AS inner_spill,
  avg(l_tax) * 10 AS neighbor_spill, count(*) % 5 AS plants, (max(l_extendedprice) - min(l_extendedprice)) / max(l_extendedprice) - 0.5 AS growth,
  avg(l_quantity) * 8 AS blur, avg(l_extendedprice) % 255 AS brightness FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey)"""


#: Bits of a row's place in its file; the file's number stands above them.
_PLACE_BITS = 40


def in_place(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with `_place`, a number that grows in its own order: by path of file, then place in the file."""
    rows = table(spark, sf_dir, name)
    files = rows.select(F.col("_metadata.file_path").alias("_file")).distinct().withColumn("_number", F.row_number().over(Window.orderBy("_file")).cast("long"))
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")).join(F.broadcast(files), "_file")
    return placed.withColumn("_place", F.shiftleft("_number", _PLACE_BITS) + F.col("_row")).drop("_file", "_number", "_row")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each part. Binary sums depend on the order of the rows, so a part's rows are added up one after the other in
    the table's own order, as the SQL does on one thread, however many tasks read the table."""
    rows = in_place(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "_place")
    j = table(spark, sf_dir, "part").select("p_partkey").join(rows, F.col("p_partkey") == F.col("l_partkey"))
    order = Window.partitionBy("p_partkey").orderBy("_place")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    price = F.col("l_extendedprice")
    sums = {f"mean_{c}": F.avg(f"l_{c}").over(so_far) for c in ("discount", "tax", "quantity", "extendedprice")}
    sums |= {"n": F.count("*").over(so_far), "low": F.min(price).over(so_far), "top": F.max(price).over(so_far), "_next": F.lead("_place").over(order)}
    discount, tax, quantity, mean_price = (F.col(f"mean_{c}") for c in ("discount", "tax", "quantity", "extendedprice"))
    return j.withColumns(sums).filter("_next IS NULL").select(
        F.col("p_partkey").alias("part"), discount.alias("coverage"), (tax * 5).alias("chlorosis"), (quantity / 50).alias("focus"), (discount * 4).alias("inner_spill"),
        (tax * 10).alias("neighbor_spill"), (F.col("n") % 5).alias("plants"), ((F.col("top") - F.col("low")) / F.col("top") - 0.5).alias("growth"),
        (quantity * 8).alias("blur"), (mean_price % 255).alias("brightness"),
    )


def photo_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_returnflag") == "N", "pot").otherwise("varietal").alias("kind"),
        (F.col("l_suppkey") % 12 + 1).alias("class_number"), (F.col("l_discount") * 10).alias("cx"), (F.col("l_tax") * 10).alias("cy"), F.lit(0.02).alias("w"), F.lit(0.02).alias("h"),
    )
