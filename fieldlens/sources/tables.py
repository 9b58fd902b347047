"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import content_hash
from .shared import stored


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with header, quoted line breaks and a byte order mark; rows that do not fit have `_corrupt_record`."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    return spark.read.csv(path, schema=full, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_json_tree(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """All JSON documents under a folder, with source_file and modified_at; unreadable ones have `_corrupt_record`."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    df = spark.read.schema(full).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("modified_at"))


def unreadable(tree: DataFrame) -> DataFrame:
    """(source_file): the documents of read_json_tree that could not be read, to be reported as unassigned.

    The read rows are stored first, as a scan cannot give its corrupt records alone.
    """
    return stored(tree.select("source_file", "_corrupt_record", *(c for c in tree.columns if c not in ("source_file", "_corrupt_record"))), "json-tree").filter(F.col("_corrupt_record").isNotNull()).select("source_file").distinct()


def flattened_album(payload: DataFrame, column: str) -> DataFrame:
    """Positional arrays [asset, [url, width, height], captured_ms, offset_ms, uploaded_ms] to rows; missing is null."""
    item = F.from_json(column, "array<array<string>>")
    at = lambda i: F.try_element_at("a", F.lit(i))
    rows = payload.select(*(c for c in payload.columns if c != column), F.posexplode_outer(item).alias("p", "a")).filter("a IS NOT NULL")
    return rows.select(
        *(c for c in payload.columns if c != column), (F.col("p") + 1).alias("photo_index"), at(1).alias("asset"), at(2).alias("url"), at(3).try_cast("int").alias("width"),
        at(4).try_cast("int").alias("height"), at(5).try_cast("bigint").alias("captured_ms"), at(6).try_cast("bigint").alias("offset_ms"),
    )


def write_fields(df: DataFrame, path: str, fields: list[str], fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Fixed columns in fixed order; columns that df lacks are null."""
    have = set(df.columns)
    df.select(*(F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in fields)).write.mode(mode).format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_run(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Writes the runs of df in the place of the same runs in the table; other runs stay, and a rerun changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def write_if_changed(df: DataFrame, path: str, state: str, but: tuple[str, ...] = ("generated_at",)) -> bool:
    """Writes only if the content, but for some columns, differs from the one noted in `state`; says whether it wrote."""
    spark = df.sparkSession
    now = content_hash(df, but).first()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(state)
    exists = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    if exists and spark.read.parquet(state).filter((F.col("rows") == now["rows"]) & (F.col("hash") == now["hash"])).count():
        return False
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([tuple(now)], "rows long, hash string").write.mode("overwrite").parquet(state)
    return True


def snapshot(tables: dict[str, DataFrame], root: str, version: str, released: str) -> DataFrame:
    """Copies tables under a version and returns its manifest rows (version_id, released, name, rows, hash)."""
    out = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/version_id={version}/{name}")
        row = content_hash(df).select(F.lit(version).alias("version_id"), F.lit(released).alias("released"), F.lit(name).alias("name"), "rows", "hash")
        out = row if out is None else out.unionByName(row)
    return out


def changed_without_version(tables: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """(code, item) for each table whose content differs from the last released version's."""
    out = None
    last = manifest.groupBy("name").agg(F.max_by("hash", F.struct("released", "version_id")).alias("known"))
    for name, df in tables.items():
        row = content_hash(df).select(F.lit(name).alias("name"), "hash")
        out = row if out is None else out.unionByName(row)
    return out.join(last, "name", "left").filter("NOT (hash <=> known)").select(F.lit("changed_without_version").alias("code"), F.col("name").alias("item"))


def yolo_lines(boxes: DataFrame, classes: list[str]) -> DataFrame:
    """(task_key, ord, value): `class cx cy w h` with six decimals; boxes of unknown labels go."""
    k = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("label")) - 1
    line = F.format_string("%d %.6f %.6f %.6f %.6f", k, F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2, F.col("w"), F.col("h"))
    return boxes.filter(k >= 0).select("task_key", "ord", line.alias("value"))


def write_yolo(boxes: DataFrame, path: str, classes: list[str]) -> None:
    yolo_lines(boxes, classes).sortWithinPartitions("task_key", "ord").select("task_key", "value").write.mode("overwrite").partitionBy("task_key").text(path)
