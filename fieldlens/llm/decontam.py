"""Benchmark decontamination by Wu-Manber multi-pattern search over whole texts."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import concat_rows, free_name, runs, scratch, slices

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
SPACE, END = 0x20, 0x0A
_FOLD = np.full(256, SPACE, np.uint8)
_FOLD[WORD] = np.flatnonzero(WORD)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_HASH = np.uint64(0x9E3779B97F4A7C15)
_BITS = 18
#: Patterns shorter than this are searched by a table of their own, so that they do not shorten everyone's steps.
SHORT = 16


def words_of(text: str | None) -> list[bytes]:
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode("utf-8", "surrogatepass").lower())


def windows_of(text: str | None, n: int) -> list[bytes]:
    """All windows of n consecutive words, joined by spaces; a text of fewer, but not none, is one window."""
    words = words_of(text)
    if not words:
        return []
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


class WuManber:
    """Shift and suffix tables over the first `m` bytes of the patterns, `m` being the shortest pattern's length.

    Many cursors walk a text at once, each through a stretch of its own: where the shift table says that the block
    under a cursor ends no pattern, it skips ahead.
    """

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.lengths = np.array([len(p) for p in patterns])
        self.m = int(self.lengths.min())
        self.block = min(8, self.m)
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        head = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(len(patterns), self.m)
        self.shift = np.full(1 << _BITS, self.m - self.block + 1, np.int64)
        value = lambda j: sum(head[:, j + i].astype(np.uint64) << np.uint64(8 * i) for i in range(self.block))
        for j in range(self.m - self.block + 1):
            np.minimum.at(self.shift, self._slot(value(j)), self.m - self.block - j)
        ends = self._slot(value(self.m - self.block))
        self.order = np.argsort(ends, kind="stable")
        self.bucket = np.searchsorted(ends[self.order], np.arange((1 << _BITS) + 1))
        self.prefix = value(0)

    @staticmethod
    def _slot(v: np.ndarray) -> np.ndarray:
        return ((v * _HASH) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, data: bytes, stretch: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of all occurrences that begin and end at word edges."""
        n = len(data)
        padded = data + bytes(8)
        blocks = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
        at = np.arange(0, max(0, n - self.m + 1), stretch)
        to = np.minimum(at + stretch, n - self.m + 1)
        stops = []
        while len(at):
            step = self.shift[self._slot(blocks[at + (self.m - self.block)] & self.mask)]
            zero = step == 0
            if zero.any():
                stops.append(at[zero])
            at = at + np.maximum(step, 1)
            alive = at < to
            if not alive.all():
                at, to = at[alive], to[alive]
        where = np.concatenate(stops) if stops else np.zeros(0, np.int64)
        slot = self._slot(blocks[where + (self.m - self.block)] & self.mask)
        low, many = self.bucket[slot], self.bucket[slot + 1] - self.bucket[slot]
        at = np.repeat(where, many)
        within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        which = self.order[np.repeat(low, many) + within]
        same = self.prefix[which] == (blocks[at] & self.mask)
        at, which = at[same], which[same]
        raw = np.frombuffer(padded, np.uint8)
        ends = np.minimum(at + self.lengths[which], n)
        edge = ((at == 0) | ~WORD[raw[np.maximum(at - 1, 0)]]) & ~WORD[raw[ends]]
        at, which = at[edge], which[edge]
        hit = np.array([data.startswith(self.patterns[k], p) for p, k in zip(at.tolist(), which.tolist())], bool)
        return (at[hit], which[hit]) if len(at) else (at, which)


def normalise(data: np.ndarray, offsets: np.ndarray) -> bytes:
    """Words in lower case with one space between them, and END after each row."""
    folded = _FOLD[data]
    folded[offsets[1:] - 1] = END
    space = folded == SPACE
    keep = np.ones(len(folded), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return folded[keep].tobytes()


class Benchmark:
    """The distinct windows of a benchmark and the items that have them."""

    def __init__(self, rows: list[tuple[str, str | None]], n: int):
        owners: dict[bytes, set[str]] = {}
        for item, text in rows:
            for w in windows_of(text, n):
                owners.setdefault(w, set()).add(item)
        self.windows = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.n_words = np.array([w.count(b" ") + 1 for w in self.windows], np.int64)
        groups = [[k for k, w in enumerate(self.windows) if (len(w) < SHORT) == short] for short in (True, False)]
        self.tables = [(np.array(g), WuManber([self.windows[k] for k in g])) for g in groups if g]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """Words of each row; then the stretches of words that windows cover, as rows, first words and ends, in order
        and apart from each other; and the items that each row meets."""
        text = normalise(data, offsets)
        raw = np.frombuffer(text, np.uint8)
        word = WORD[raw]
        first = word.copy()
        first[1:] &= ~word[:-1]
        ends = np.flatnonzero(raw == END)
        number = np.cumsum(first, dtype=np.int64)
        upto = number[ends]
        n_words = np.diff(upto, prepend=0)
        hit = np.zeros(int(number[-1]) + 1 if len(number) else 1, np.int64)
        items: list[set[str]] = [set() for _ in ends]
        for which, table in self.tables:
            at, k = table.find(text)
            k = which[k]
            np.add.at(hit, number[at] - 1, 1)
            np.add.at(hit, number[at] - 1 + self.n_words[k], -1)
            for row, window in set(zip(np.searchsorted(ends, at).tolist(), k.tolist())):
                items[row].update(self.owners[window])
        starts, stops = runs(np.cumsum(hit)[:-1] > 0) if len(hit) > 1 else (np.zeros(0, np.int64),) * 2
        row = np.searchsorted(upto, starts, side="right")
        # a stretch that goes on from one row's last word into the next row is parted
        last = np.searchsorted(upto, stops - 1, side="right")
        many = last - row + 1
        owner = np.repeat(row, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = np.maximum(np.repeat(starts, many), upto[owner] - n_words[owner])
        end = np.minimum(np.repeat(stops, many), upto[owner])
        base = upto[owner] - n_words[owner]
        return n_words, owner, begin - base, end - base, [sorted(s) for s in items]


SPANS = "array<struct<a:int,b:int>>"


def _searched(rows: DataFrame, bench: Benchmark, text: str, every: bool) -> DataFrame:
    """rows, without the text, with n_words, spans of hit words and items; with `every`, also rows that meet nothing."""
    sent = rows.sparkSession.sparkContext.broadcast(bench)
    kept = [f for f in rows.schema if f.name != text]
    schema = T.StructType(kept + list(T.StructType.fromDDL(f"n_words long, spans {SPANS}, items array<string>").fields))
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, spans, met = [], [], []
            for _, _, data, offsets in slices(batch.column(batch.schema.names.index(text))):
                n, owner, a, b, items = sent.value.scan(data, offsets)
                words.append(n)
                met += items
                cut = np.searchsorted(owner, np.arange(len(n) + 1))
                a, b = a.tolist(), b.tolist()
                spans += [[{"a": a[k], "b": b[k]} for k in range(x, y)] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]
            if not met:
                continue
            new = {"n_words": pa.array(np.concatenate(words), pa.int64()), "spans": pa.array(spans, pair), "items": pa.array(met, pa.list_(pa.string()))}
            out = concat_rows(batch, [text], new)
            yield out if every else out.filter(pa.array([bool(m) for m in met], pa.bool_()))

    return rows.mapInArrow(search, schema)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    part_bytes: int = 4 << 20,
) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted ids), items_sha256 and contaminated.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A word is hit if it lies in any
    occurrence of a window of n consecutive words of an item. Null and empty texts have no words; items without words
    or without an id have no window; an item that is repeated counts once. Repeated documents are each judged; no rows
    give no rows; an empty benchmark hits nothing. `keep` names the columns to carry (all without it); those that clash
    with new ones are replaced.

    The windows of up to part_bytes of benchmark text are sent to every task. A larger benchmark is searched in parts of
    about that size, dealt by item: each part's hits are written, and a row's stretches and items of all parts are put
    together. One item's text is never parted.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").alias("t")).filter("i IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    part = lambda k: Benchmark([(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == k).toLocalIterator()], n)
    new = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in new]
    # names that no column of docs has
    body, spans, uid = (free_name(docs, c) for c in ("_body", "spans", "_uid"))
    inner = [f"_k{k}" for k in range(len(carried))]
    source = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(carried, inner)), F.col(f"`{text}`").alias(body))
    if parts == 1:
        found = _searched(source, part(0), body, True)
    else:
        source = scratch(source.withColumn(uid, F.monotonically_increasing_id()), "decontam-rows")
        found = scratch(_searched(source, part(0), body, True), "decontam-part")
        others = [scratch(_searched(source.select(uid, body), part(k), body, False), "decontam-part") for k in range(1, parts)]
        every = functools.reduce(DataFrame.unionByName, others).groupBy(uid).agg(F.flatten(F.collect_list("spans")).alias("_s"), F.flatten(F.collect_list("items")).alias("_i"))
        found = found.join(every, uid, "left")
        both = lambda a, b: F.array_distinct(F.array_sort(F.concat(a, F.coalesce(b, F.array()))))
        found = found.withColumns({"spans": both("spans", F.col("_s")), "items": both("items", F.col("_i"))})
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"))
    n_hit = F.aggregate("spans", start, step, lambda s: s["n"])
    return found.select(
        *(F.col(k).alias(c) for c, k in zip(carried, inner)),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
