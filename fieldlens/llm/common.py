"""Helpers shared by the corpus operators: scratch tables and byte-level numpy tools."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share. A session that names none gets a local one in local mode, as in tests; on
    a cluster that is an error, since other machines could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the files of a scratch table that no later step reads. Only folders in the shared one are touched."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    inside = path(shared_dir(spark)).toUri().getPath() + "/"
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        at = path(folder)
        if at.toUri().getPath().startswith(inside):
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def places_up_to(sorted_: Column, size: int, key: Column) -> Column:
    """How many elements of a sorted array column of that size are at most key: a binary search."""
    def halved(s):
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        left = F.get(sorted_, mid) <= key
        return F.struct(F.when(left, mid + 1).otherwise(s["low"]).alias("low"), F.when(left, s["high"]).otherwise(mid).alias("high"))

    steps, span = F.sequence(F.lit(1), F.lit(max(1, size.bit_length()))), F.struct(F.lit(0).alias("low"), F.lit(size).alias("high"))
    return F.aggregate(steps, span, lambda s, _: F.when(s["low"] < s["high"], halved(s)).otherwise(s), lambda s: s["low"])


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (splitmix)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def table_of(seed: int, n: int = 256) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _ODD + np.uint64(seed))


_BYTE = table_of(7)
_BASE = 0xD1342543DE82EF95
#: Bytes that are hashed at once; the tables of powers are as long.
HASH_BYTES = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            powers = np.full(HASH_BYTES + 1, base, dtype=np.uint64)
            powers[0] = 1
            _POWERS.append(np.cumprod(powers, dtype=np.uint64))
    return _POWERS


def _sum_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum over each span of its bytes' numbers times powers of the base, for spans within HASH_BYTES."""
    powers, inverse = _powers()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans in order, from running sums over stretches of the bytes.

    Two different spans agree with a chance of about 2**-64. Beside the result, memory is that of one stretch, however
    long the data; a span longer than a stretch is summed piece by piece.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        to = int(np.searchsorted(ends, begin + HASH_BYTES, side="right"))
        if to > at:
            out[at:to] = _sum_hashes(data[begin : int(ends[to - 1])], starts[at:to] - begin, ends[at:to] - begin)
        else:
            total, to = 0, at + 1
            for piece in range(begin, int(ends[at]), HASH_BYTES):
                part = data[piece : min(piece + HASH_BYTES, int(ends[at]))]
                one = int(_sum_hashes(part, np.zeros(1, np.int64), np.array([len(part)]))[0])
                total += one * pow(_BASE, piece - begin, 1 << 64)
            out[at] = total % (1 << 64)
        at = to
    return mix64(out + (ends - starts).astype(np.uint64) * _ODD)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 0x20
    return t


LOWER = lower_table()
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(WHITESPACE)] = False


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about `most` bytes: first row, last row + 1, bytes, row offsets.

    Null is empty. A row longer than `most` gets a run of its own. Between rows stands one newline, so that no word
    or window crosses rows: row i has bytes[offsets[i]:offsets[i + 1] - 1]. Only one run is held at a time.
    """
    at, size, part = 0, 0, []
    for begin in range(0, len(column), 128):
        for text in column.slice(begin, 128).to_pylist():
            raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
            if part and size + len(raw) > most:
                yield at, at + len(part), *_joined(part)
                at, size, part = at + len(part), 0, []
            part.append(raw)
            size += len(raw) + 1
    if part:
        yield at, at + len(part), *_joined(part)


def _joined(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(part) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in part], out=offsets[1:])
    return np.frombuffer(b"\n".join(part) + b"\n", np.uint8), offsets


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket (a number from 0) that occurs, with the places of its entries."""
    bucket = bucket.astype(np.uint16 if len(bucket) and bucket.max() < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1, append=-1))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(bucket[order[a]]), order[a:b]


def slot(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its higher half."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def concat_rows(batch: pa.RecordBatch, drop: Iterable[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch without the columns in drop, followed by the new ones."""
    gone = set(drop)
    keep = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n not in gone]
    keep += list(new.items())
    return pa.RecordBatch.from_arrays([a for _, a in keep], names=[n for n, _ in keep])


def crc32_of_id(spark_column):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(spark_column.cast("string"), F.lit("")))
