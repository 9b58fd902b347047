"""Tables that later steps read more than once, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in that of spark.checkpoint.dir. Only local sessions may name none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to a folder that all machines share, and read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked(*small: DataFrame, most: int = 200_000, most_bytes: int = 64 << 20) -> list[DataFrame]:
    """Each table, to be broadcast if it has at most so many rows and bytes (as JSON); other joins are left to Spark.

    One job measures all of them.
    """
    sizes = [
        t.limit(most + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in t.columns))))), F.lit(0)).alias("bytes")).withColumn("i", F.lit(i))
        for i, t in enumerate(small)
    ]
    fits = {r["i"] for r in reduce(DataFrame.unionByName, sizes).collect() if r["n"] <= most and r["bytes"] <= most_bytes}
    return [F.broadcast(t) if i in fits else t for i, t in enumerate(small)]
