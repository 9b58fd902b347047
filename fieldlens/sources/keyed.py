"""Tables dealt into key buckets, with versions: a batch writes the buckets that it touches and then a manifest.

`root`/data/version=<n>/bucket=<b> holds the rows of a bucket as version n left it; `root`/manifest/version=<n> has one row for
each bucket, (bucket, at, rows, digest), `at` being the version whose files are current. A version counts once its
manifest is whole, so a run that fails leaves the last version as it was, and one that is repeated does its work once.
Digests say which buckets of two versions differ, so a comparison reads no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.merge import upsert

MANIFEST = "bucket int, at long, rows long, digest string"


def _fs(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The whole versions of a table, in order."""
    fs, path = _fs(spark, f"{root}/manifest")
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName().removeprefix("version=")) for p in names if fs.exists(_fs(spark, f"{p.toString()}/_SUCCESS")[1]))


def manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={version}")


def read(spark: SparkSession, root: str, schema, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version (default: the last one), of some buckets only if they are named."""
    found = versions(spark, root)
    version = found[-1] if version is None and found else version
    if version is None:
        return spark.createDataFrame([], schema)
    if version not in found:
        raise ValueError(f"version {version} of {root} is not whole")
    entries = [r for r in manifest(spark, root, version).filter("rows > 0").collect() if buckets is None or r["bucket"] in set(buckets)]
    paths = [f"{root}/data/version={r['at']}/bucket={r['bucket']}" for r in entries]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge(batch: DataFrame, root: str, keys: list[str], order: str, version: int | None = None, buckets: int = 64, keep: tuple[str, ...] = (), versions_kept: int = 3) -> int:
    """Merges a batch into the table as its next version (or the one named) and returns it: the last row of a key by
    order takes the place of the table's; columns in keep stay the table's own. Only touched buckets are read and written.

    The batch has no column `bucket`. A version that is whole already is left alone, and one whose predecessor is not there is an error. Files that none of the
    last versions_kept versions uses are deleted. The number of buckets is that of the first version.
    """
    spark, done = batch.sparkSession, versions(batch.sparkSession, root)
    version = version if version is not None else (done[-1] + 1 if done else 0)
    if version in done:
        return version
    if done and done[-1] != version - 1 or not done and version:
        raise ValueError(f"version {version - 1} of {root} is not whole (last: {done[-1] if done else None})")
    # a bucket's row in each manifest, so their number is known from the last one
    old = {r["bucket"]: r for r in manifest(spark, root, version - 1).collect()} if done else {}
    buckets = len(old) or buckets
    dealt = batch.withColumn("bucket", _bucket(keys, buckets))
    touched = sorted(r["bucket"] for r in dealt.select("bucket").distinct().collect())
    base = read(spark, root, batch.schema, version - 1, touched) if done else spark.createDataFrame([], batch.schema)
    merged = upsert(base, batch, keys, order, keep).select(*batch.columns)
    data = f"{root}/data/version={version}"
    placed = merged.withColumn("bucket", _bucket(keys, buckets))
    placed.repartition(max(1, min(len(touched), buckets)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    written = spark.read.schema(T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(data)
    digest = F.sum(F.xxhash64(*sorted(batch.columns)).cast("decimal(38,0)")).cast("string")
    now = {r["bucket"]: (version, r["n"], r["digest"]) for r in written.groupBy("bucket").agg(F.count("*").alias("n"), digest.alias("digest")).collect()}
    rows = [(b, *(now[b] if b in now else (old[b]["at"], old[b]["rows"], old[b]["digest"]) if b in old else (version, 0, "0"))) for b in range(buckets)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/version={version}")
    _forget(spark, root, versions_kept)
    return version


def _forget(spark: SparkSession, root: str, kept: int) -> None:
    """Deletes manifests but the last ones, and the buckets' files that none of these name."""
    done = versions(spark, root)
    used = {(r["at"], r["bucket"]) for v in done[-kept:] for r in manifest(spark, root, v).collect()}
    for v in done[:-kept]:
        fs, path = _fs(spark, f"{root}/manifest/version={v}")
        fs.delete(path, True)
    fs, path = _fs(spark, f"{root}/data")
    for version in fs.listStatus(path):
        number = int(version.getPath().getName().removeprefix("version="))
        for part in fs.listStatus(version.getPath()) if number < done[-1] else []:
            name = part.getPath().getName()
            if name.startswith("bucket=") and (number, int(name.removeprefix("bucket="))) not in used:
                fs.delete(part.getPath(), True)


def changed_buckets(spark: SparkSession, root: str, old: int, new: int) -> list[int]:
    """The buckets whose content differs between two versions: a row each, whatever the table's size."""
    side = lambda v: {r["bucket"]: (r["rows"], r["digest"]) for r in manifest(spark, root, v).collect()}
    a, b = side(old), side(new)
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def difference(spark: SparkSession, root: str, schema, keys: list[str], old: int, new: int) -> DataFrame:
    """(keys, change): added, removed and changed keys between two versions; only buckets that differ are read."""
    some = changed_buckets(spark, root, old, new)
    rest = [c for c in spark.createDataFrame([], schema).columns if c not in keys]
    side = lambda v, n: read(spark, root, schema, v, some).select(*keys, F.struct(*rest).alias(n))
    both = side(old, "_a").withColumn("_in_a", F.lit(True)).join(side(new, "_b").withColumn("_in_b", F.lit(True)), keys, "full")
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*keys, change.alias("change")).filter("change IS NOT NULL")
