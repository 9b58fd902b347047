"""Incremental intake on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import keyed


def asset_stream(spark: SparkSession, path: str, schema: str, time: str, key: str, late: str = "2 days", per_trigger: int = 100) -> DataFrame:
    """New files under path as rows, each asset once within the watermark."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return raw.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_counts(stream: DataFrame, time: str, by: str) -> DataFrame:
    """Rows per day and kind; a day is final once the watermark has passed it."""
    return stream.groupBy(F.window(time, "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), by, "n")


def upsert_feed(stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64, versions_kept: int = 3):
    """Starts a query that merges each batch into a keyed table as the version of its number (see sources.keyed).

    A batch writes only the buckets of its keys; one that is run again finds its version whole, or writes it anew.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        keyed.merge(batch, table, keys, order, batch_id, buckets, versions_kept=versions_kept)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", seconds: int = 3600) -> DataFrame:
    """Runs a stream over all that is there now, and returns the rows that it has written so far."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream into {path} has not come to its end")
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
