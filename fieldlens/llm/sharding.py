"""Sharding by histogram sort: exact bytes below candidate key boundaries are counted over all partitions, the
boundaries refined until they meet a tolerance, and then the rows are exchanged once. DataFrame functions only."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import discard, free_name, places_up_to, scratch

ROW_BYTES = 16
LOWEST = -(1 << 63)
KEY = ("k0", "k1", "k2")


@dataclass(frozen=True)
class Splitter:
    """The first key (text hash, id, row number of the scan) of a piece."""

    k0: int
    k1: int
    k2: int


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def _keyed(docs: DataFrame, text: str, doc_id: str, names: dict[str, str]) -> DataFrame:
    """docs with the sort key: equal texts are neighbours, and ids and row numbers tell rows of one text apart."""
    body, own = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    # ids that are no whole numbers are ordered by their hashes
    whole = isinstance(docs.schema[doc_id].dataType, T.IntegralType)
    number = own.cast("long") if whole else F.when(own.isNotNull(), F.xxhash64(own))
    return docs.withColumns(
        {
            names["k0"]: F.coalesce(F.conv(F.substring(F.md5(body.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(-1)),
            names["k1"]: F.coalesce(number, F.lit(LOWEST)),
            names["k2"]: F.monotonically_increasing_id(),
            names["size"]: size_of(body),
        }
    )


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of longs from the driver as a VALUES clause (LOWEST has no literal of its own)."""
    text = ", ".join("(" + ", ".join(f"CAST('{v}' AS BIGINT)" if v == LOWEST else f"{v}L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(f'`{n}`' for n in names)})")


def find_splitters(keys: DataFrame, pieces: int, tolerance: float, cells_per_piece: int = 64) -> tuple[list[Splitter], int]:
    """The splitters that cut keys (k0, k1, k2, size) into pieces of near equal bytes, and the rows.

    Every round lays a grid of cells over each interval that still holds a target, counts the bytes of each
    cell exactly and notes its least and greatest key. A target is met when a cell's edge lies within
    tolerance * (bytes of a piece), or when its cell holds one key only. An interval whose rows all share the text
    hash is cut by id, and one whose rows share that as well by row number, so that a hot text is split like any other.
    Intervals shrink by their number of cells, so the rounds end. A round writes the keys that are still in an open
    interval, so that none repeats the work of those before it. The driver sees, each round, at most cells_per_piece
    counts for each target and open interval: 128 times the pieces.
    """
    spark = keys.sparkSession
    whole = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("lo"), F.max(F.struct(*KEY)).alias("hi")).first()
    total, rows = int(whole["b"] or 0), int(whole["n"])
    if rows == 0 or pieces < 2:
        return [], rows
    open_cells = {0: (0, tuple(whole["lo"]), tuple(whole["hi"]), [total * j / pieces for j in range(1, pieces)])}
    met: dict[float, tuple] = {}
    at, written = keys.withColumn("interval", F.lit(0).cast("long")), None
    while open_cells:
        plan = []
        for i, (_, lo, hi, targets) in open_cells.items():
            d = next((k for k in range(3) if lo[k] != hi[k]), 2)
            width = hi[d] - lo[d] + 1
            plan.append((i, d, lo[d], -(-width // (cells_per_piece * (len(targets) + 1)))))
        grid = F.broadcast(_table(spark, plan, ["interval", "d", "low", "step"]))
        on = F.when(F.col("d") == 0, F.col("k0")).when(F.col("d") == 1, F.col("k1")).otherwise(F.col("k2"))
        # decimals, as the difference of two longs need not fit one
        index = F.floor((on.cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)")) / F.col("step").cast("decimal(20,0)")).cast("long")
        at = at.join(grid, "interval").withColumn("cell", index).select(*KEY, "size", "interval", "cell")
        counts = at.groupBy("interval", "cell").agg(F.sum("size").alias("b"), F.min(F.struct(*KEY)).alias("lo"), F.max(F.struct(*KEY)).alias("hi")).collect()
        found: dict[int, list] = {}
        for r in counts:
            found.setdefault(r["interval"], []).append((r["cell"], int(r["b"]), tuple(r["lo"]), tuple(r["hi"])))
        nxt: dict[tuple, tuple] = {}
        for i, (before, _, _, targets) in open_cells.items():
            acc, spans = before, []
            for cell, size, lo, hi in sorted(found[i]):
                spans.append((acc, acc + size, cell, lo, hi))
                acc += size
            ends = [s[1] for s in spans]
            for t in targets:
                k = min(bisect.bisect_left(ends, t), len(spans) - 1)
                start, end, cell, lo, hi = spans[k]
                edges = [(abs(start - t), lo), (abs(end - t), spans[k + 1][3] if k + 1 < len(spans) else _after(hi))]
                gap, key = min(edges)
                if lo == hi or gap <= tolerance * total / pieces:
                    met[t] = key
                else:
                    nxt.setdefault((i, cell), (start, lo, hi, []))[3].append(t)
        numbered = sorted(nxt)
        open_cells = {k: nxt[c] for k, c in enumerate(numbered)}
        if numbered:
            renamed = F.broadcast(_table(spark, [(*c, k) for k, c in enumerate(numbered)], ["interval", "cell", "as"]))
            at = scratch(at.join(renamed, ["interval", "cell"]).select(*KEY, "size", F.col("as").alias("interval")), "shard-round")
        if written is not None:
            discard(written)
        written = at if numbered else None
    return [Splitter(*met[t]) for t in sorted(met)], rows


def _after(key: tuple) -> tuple:
    return (key[0], key[1], key[2] + 1)


def with_piece(rows: DataFrame, splitters: list[Splitter], key: list[str], name: str) -> DataFrame:
    """rows with the number of splitters at or below their key: a binary search of the sorted splitters, which are one
    broadcast row (24 bytes each, as many as pieces)."""
    if not splitters:
        return rows.withColumn(name, F.lit(0))
    cuts = free_name(rows, "_cuts")
    table = _table(rows.sparkSession, [(i, s.k0, s.k1, s.k2) for i, s in enumerate(splitters)], ["i", *KEY])
    one = table.agg(F.array_sort(F.collect_list(F.struct(*KEY))).alias(cuts))
    own = F.struct(*(F.col(k).alias(n) for k, n in zip(key, KEY)))
    found = places_up_to(F.col(cuts), len(splitters), own)
    return rows.join(F.broadcast(one), F.lit(True)).withColumn(name, found).drop(cuts)


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 40,
    tolerance: float = 0.001,
    text: str = "text",
    doc_id: str = "doc_id",
    rows_per_piece: int = 2_000_000,
) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot and grown_shard, law `bytes`: shards hold near equal bytes.

    A row counts its UTF-8 bytes (null: none) plus 16. Rows are ordered by text hash, id and row number, so rows of
    equal texts stand together and only a shard's edge parts them; a text with a third of the rows fills several
    shards. Row numbers are stored with the rows before any of them is counted, as ones taken anew depend on how the
    files are split. A shard misses its target by at most tolerance * (bytes of a shard) or half a row at either edge.
    slot numbers a shard's rows from 0 without gaps in that order. Large shards are sorted in several pieces of about
    rows_per_piece rows, whose exact counts give the offsets. text_crc32 of a null text is null; null ids come first.
    grown_shard is null, as only law `key` has it. Repeated rows stay; no rows give no rows; columns of docs that
    clash with new ones are replaced.
    """
    new = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    names = {k: free_name(docs, f"_{k}") for k in (*KEY, "size", "piece", "off")}
    keyed = scratch(_keyed(docs, text, doc_id, names), "shard-rows")
    own = [names[k] for k in KEY]
    keys = keyed.select(*(F.col(names[k]).alias(k) for k in (*KEY, "size")))
    per = max(1, -(-keys.count() // (shards * rows_per_piece)))
    splitters, _ = find_splitters(keys, shards * per, tolerance)
    dealt = with_piece(keyed, splitters, own, names["piece"]).repartitionById(shards * per, F.col(names["piece"]))
    order = Window.partitionBy(names["piece"]).orderBy(*own)
    slot = F.row_number().over(order).cast("long") - 1
    if per > 1:
        counts = {r["p"]: r["count"] for r in with_piece(keys, splitters, list(KEY), "p").groupBy("p").count().collect()}
        offsets, acc = [], 0
        for p in range(shards * per):
            acc = 0 if p % per == 0 else acc
            offsets.append((p, acc))
            acc += counts.get(p, 0)
        table = _table(docs.sparkSession, offsets, ["p", "o"]).select(F.col("p").cast("int").alias(names["piece"]), F.col("o").alias(names["off"]))
        dealt = dealt.withColumn("slot", slot).join(F.broadcast(table), names["piece"]).withColumn("slot", F.col("slot") + F.col(names["off"]))
    else:
        dealt = dealt.withColumn("slot", slot)
    return dealt.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.col(names["size"]).alias("size"),
        F.crc32(F.col(f"`{text}`").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.floor(F.col(names["piece"]) / F.lit(per)).cast("int").alias("shard"),
        F.col("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
