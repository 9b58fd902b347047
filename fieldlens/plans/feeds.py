"""Keyed tables, their differences, and streams that run to their end over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import keyed
from ..sources.shared import new_folder
from ..streaming import intake, monitor
from . import adapters as ad
from .registry import query


def _versions(spark, sf_dir):
    """A keyed table with two versions: customers, and a later feed of a few of them and of new ones."""
    c = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance"), F.lit(0).alias("seq"))
    root = new_folder(spark, "customers")
    keyed.merge(c.filter("k % 5 <> 0"), root, ["k"], "seq", buckets=16)
    later = c.filter("k % 50 IN (0, 1)").withColumn("balance", F.when(F.col("k") % 100 != 1, F.col("balance") + 1).otherwise(F.col("balance")))
    keyed.merge(later, root, ["k"], "seq")
    return root, c.schema


_VERSIONS = """a AS (SELECT c_custkey AS k, c_name AS name, CAST(c_acctbal AS DOUBLE) AS balance FROM customer WHERE c_custkey % 5 <> 0),
l AS (SELECT c_custkey AS k, c_name AS name, CAST(c_acctbal AS DOUBLE) + CASE WHEN c_custkey % 100 <> 1 THEN 1 ELSE 0 END AS balance FROM customer WHERE c_custkey % 50 IN (0, 1)),
b AS (SELECT * FROM l UNION ALL SELECT * FROM a WHERE k NOT IN (SELECT k FROM l))"""


@query(f"WITH {_VERSIONS} SELECT k, name, round(balance, 6) AS balance FROM b")
def keyed_table(spark, sf_dir):
    root, schema = _versions(spark, sf_dir)
    return keyed.read(spark, root, schema).select("k", "name", F.round("balance", 6).alias("balance"))


@query(f"WITH {_VERSIONS} SELECT k, CASE WHEN a.k IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b USING (k) WHERE a.balance IS DISTINCT FROM b.balance")
def version_difference(spark, sf_dir):
    root, schema = _versions(spark, sf_dir)
    return keyed.difference(spark, root, schema, ["k"], 0, 1)


def _events(spark, sf_dir):
    """The folder of an intake of events, and its schema."""
    rows = ad.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").filter("user_id IS NOT NULL")
    path = new_folder(spark, "intake")
    rows.write.parquet(path)
    return path, rows.schema


@query("SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def asset_stream(spark, sf_dir):
    path, schema = _events(spark, sf_dir)
    rows = intake.asset_stream(spark, path, schema, "ts", "user_id", late="36500 days")
    root = new_folder(spark, "assets")
    return intake.to_end(rows.select("user_id"), f"{root}/rows", f"{root}/state")


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events
WHERE user_id IS NOT NULL AND CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE user_id IS NOT NULL) - INTERVAL 2 DAY GROUP BY 1, 2""")
def daily_counts(spark, sf_dir):
    path, schema = _events(spark, sf_dir)
    stream = spark.readStream.schema(schema).parquet(path).withWatermark("ts", "2 days")
    root = new_folder(spark, "days")
    return intake.to_end(intake.daily_counts(stream, "ts", "event_type"), f"{root}/rows", f"{root}/state").withColumn("day", F.to_date("day"))


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(event_type, (ts, event_id)) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def upsert_feed(spark, sf_dir):
    path, schema = _events(spark, sf_dir)
    stream = spark.readStream.schema(schema).parquet(path).withColumn("seq", F.struct("ts", "event_id"))
    root = new_folder(spark, "users")
    intake.upsert_feed(stream, f"{root}/table", ["user_id"], "seq", f"{root}/state").awaitTermination()
    return keyed.read(spark, f"{root}/table", stream.schema).select("user_id", "event_id", "event_type")


_MONITORED = """m AS (SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d') AS d, event_type, r.run FROM events, (VALUES (1, 10), (2, 20), (3, 99)) r(run, days)
  WHERE ts < TIMESTAMP '2024-01-01' + r.days * INTERVAL 1 DAY AND (r.run = 1 OR event_type <> 'error')),
t AS (SELECT run, count(*) AS total_assets, count(DISTINCT d) AS unique_dates, max(d) AS latest FROM m GROUP BY run),
x AS (SELECT r.run, CASE WHEN c.id IS NULL THEN 'removed' ELSE 'added' END AS change, coalesce(c.d, p.d) AS d FROM (VALUES (1), (2), (3)) r(run)
  JOIN (SELECT DISTINCT id FROM m) i ON TRUE LEFT JOIN m c ON c.id = i.id AND c.run = r.run LEFT JOIN m p ON p.id = i.id AND p.run = r.run - 1 WHERE (c.id IS NULL) <> (p.id IS NULL))"""


def _monitored(spark, sf_dir):
    """Three runs over a manifest that grows; photos of a kind are gone from the second run on."""
    e = ad.table(spark, sf_dir, "events")
    root = new_folder(spark, "monitor")
    for run, days in ((1, 10), (2, 20), (3, 99)):
        seen = e.filter(F.col("ts") < F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(days)))
        seen = seen if run == 1 else seen.filter("event_type <> 'error'")
        day = F.date_format("ts", "yyyy-MM-dd")
        rows = seen.select(F.col("event_id").cast("string").alias("asset_id"), day.alias("capture_date"), F.col("ts").cast("string").alias("captured_at"), F.lit("1").alias("photo_index"), F.col("event_id").alias("row_index"))
        monitor.observe(rows, root, run)
    return root


@query(f"""WITH {_MONITORED}, n AS (SELECT t.*, coalesce(lag(latest) OVER (ORDER BY run), '') AS before FROM t)
SELECT run, total_assets, unique_dates, latest AS latest_capture_date, before AS comparison_latest_capture_date, count(*) FILTER (change = 'added') AS added_count, count(*) FILTER (change = 'removed') AS removed_count,
 count(*) FILTER (change = 'added' AND d >= before) AS forward_added_count, count(*) FILTER (change = 'removed' AND d >= before) AS forward_removed_count FROM n LEFT JOIN x USING (run) GROUP BY ALL""")
def monitor_history(spark, sf_dir):
    return monitor.history(spark, _monitored(spark, sf_dir)).drop("comparison_source")


@query(f"WITH {_MONITORED} SELECT change, d AS capture_date, count(*) AS n FROM x WHERE run = 2 GROUP BY ALL")
def monitor_moves(spark, sf_dir):
    return monitor.moves_by_date(spark, _monitored(spark, sf_dir), 2)
