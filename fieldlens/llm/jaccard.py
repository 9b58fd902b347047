"""N-gram Jaccard join: all documents whose shingle sets have a Jaccard similarity of at least a threshold are linked.

1. Documents with equal sets form a class; from here on a class counts once, however many copies it has.
2. Tiles of two neighbouring size bands: within a tile, two sets that are similar enough differ in at most k shingles.
   Each set is cut by hash range into more than k parts, so two similar sets agree in a part; the hash of a part's
   content is the class's address in the tile. No similar pair can miss all of its addresses.
3. Classes at one address are compared by hashed bitmaps: bits that differ bound the overlap from above.
4. What may still be similar is gathered in clusters, and exact sorted-array intersections decide, in blocks of bounded
   size: every pair of classes of a cluster that sizes and bitmaps leave is compared once, in the task of its two blocks.
   Where only components are asked for, pairs that earlier links have joined already are not compared.
5. Components of the exact links, and each document's number of links: a link of classes counts as often as they have
   copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, dealt, discard, free_name, mix64, runs, scratch, slices, slot, span_hashes

#: Classes of one address or cluster that a task compares with as many others: a group is cut into blocks of BLOCK at
#: least, into no more than MOST_BLOCKS until these hold LARGE_BLOCK.
BLOCK, MOST_BLOCKS, LARGE_BLOCK = 64, 24, 1024
#: An address with so many classes in one task's part is taken out of its bucket.
HEAVY = 64
SMALL = 24
MOST_BITS = 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's n-word shingles; fewer words are one shingle, none make none."""
    ws, we = runs(NOT_SPACE[data])
    words = span_hashes(LOWER[data], ws, we)
    cut = np.searchsorted(ws, offsets)
    if len(words) >= n:
        grams = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            grams = mix64(grams * _ODD + words[k : len(words) - n + 1 + k])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for i in range(a, b):
                one = mix64(one * _ODD + words[i : i + 1])
            yield one
        else:
            yield np.zeros(0, np.uint64)


def class_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(mix64(np.add.reduce(mix64(s ^ _ODD), keepdims=True) + np.array([len(s)], np.uint64) * _ODD).view(np.int64)[0])


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n: the power of two that is at least n."""
    return min(MOST_BITS, max(64, 1 << int(n - 1).bit_length()))


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """Each bit is the parity of the shingles that hash to it; two bits that differ need a shingle that differs."""
    odd = np.bincount((mix64(s + _ODD) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap at a smaller width: halves are added up modulo 2."""
    while len(words) * 64 > bits:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


class Tiles:
    """Size bands and, for each tile (a band and the next), the parts into which sets are cut.

    num / den is the threshold. In a tile, similar sets differ in at most k shingles; of k + 1 + spare parts at least
    spare + 1 agree, so one that is not empty agrees in any set with at most `spare` empty parts. Sets with more
    empty parts also take the addresses of empty parts.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]
        self.known: dict[int, tuple[int, int]] = {}

    def band(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(self.lows[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def parts(self, tile: int) -> tuple[int, int]:
        if tile in self.known:
            return self.known[tile]
        low, top = self.lows[tile], self.lows[tile + 1] - 1
        k = top * (self.den - self.num) // self.num
        spare = 0
        for _ in range(4):
            parts = k + 1 + spare
            empty = parts * np.exp(-low / parts) if parts > 1 else 0.0
            spare = int(np.ceil(empty + 4 * np.sqrt(empty))) if empty > 1e-9 else 0
        self.known[tile] = (k + 1 + spare, spare)
        return self.known[tile]

    def addresses(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Addresses of a set, and the tile of each."""
        band = self.band(len(s))
        content = mix64(s * _ODD + np.uint64(99))
        out, tiles = [], []
        for tile in (band - 1, band):
            if tile < 0:
                continue
            parts, spare = self.parts(tile)
            part = (((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            at = np.flatnonzero(np.diff(part, prepend=-1))
            sums = np.add.reduceat(content, at)
            own = part[at].astype(np.uint64)
            salt = np.uint64((tile + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
            found = mix64(mix64(sums) + salt + own * _ODD)
            if parts - len(at) > spare:
                none = np.setdiff1d(np.arange(parts), part[at]).astype(np.uint64)
                found = np.concatenate([found, mix64(mix64(none + np.uint64(7)) + salt)])
            out.append(found)
            tiles.append(np.full(len(found), tile, np.int32))
        return np.concatenate(out), np.concatenate(tiles)

    def similar(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (a + b - common)

    def may_differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most shingles in which sets of these sizes may differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


class Forest:
    """Labels of items joined so far, for numpy."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, one: int, others: np.ndarray) -> None:
        own = self.label[one]
        for old in np.unique(self.label[others]):
            if old != own:
                self.label[self.label == old] = own


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least item reachable from each of n items over the edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def described(docs: DataFrame, n: int, text: str, carry: list[str]) -> DataFrame:
    """Carried columns with n_shingles, class and bitmap (null for empty sets)."""
    source = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text}`").alias("__text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, maps = [], [], []
            for _, _, data, offsets in slices(batch.column(len(carry))):
                for s in shingle_sets(data, offsets, n):
                    sizes.append(len(s))
                    names.append(class_of(s) if len(s) else None)
                    maps.append(bitmap(s, width_of(len(s))).tobytes() if len(s) else None)
            cols = [batch.column(i) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(maps, pa.binary())], names=[*carry, "n_shingles", "class", "bitmap"]
            )

    schema = docs.select(*(F.col(f"`{c}`") for c in carry)).schema.add("n_shingles", "long").add("class", "long").add("bitmap", "binary")
    return source.mapInArrow(describe, schema)


def shared_addresses(docs: DataFrame, n: int, tiles: Tiles, text: str, buckets: int) -> DataFrame:
    """(address, tile, class, others): the addresses that several classes share; others is the number of these classes.

    Tasks send their addresses, each class once, as packed arrays to the bucket of the address. An address that many
    classes of a task's part have is known to be shared: two of the classes go to the bucket, where they meet those of
    other parts, and the rest pass through buckets of their class, so no bucket grows with a hot address.
    """
    source = docs.select(F.col(f"`{text}`").alias("text"))

    def packed(address: np.ndarray, tile: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(address, kind="stable")
        address, tile, name = address[order], tile[order], name[order]
        first = np.flatnonzero(np.diff(address, prepend=~address[:1]))
        nth = np.arange(len(address)) - np.repeat(first, np.diff(np.append(first, len(address))))
        many = np.repeat(np.diff(np.append(first, len(address))), np.diff(np.append(first, len(address))))
        # buckets beyond those of addresses hold what is known to be shared
        spans = list(dealt(np.where((many >= HEAVY) & (nth > 1), buckets + slot(mix64(name.view(np.uint64)), buckets), slot(address, buckets))))
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _ in spans], pa.int32())] + [pa.array([x[i].tobytes() for _, i in spans], pa.binary()) for x in (address, tile, name)],
            names=["bucket", "addresses", "tiles", "classes"],
        )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kept: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                for s in shingle_sets(data, offsets, n):
                    if not len(s) or (name := class_of(s)) in seen:
                        continue
                    seen.add(name)
                    address, tile = tiles.addresses(s)
                    for to, what in zip(kept, (address, tile, np.full(len(address), name, np.int64))):
                        to.append(what)
                    size += len(address)
                if size > 1 << 21:
                    yield packed(*(np.concatenate(k) for k in kept))
                    kept, size, seen = ([], [], []), 0, set()
        if size:
            yield packed(*(np.concatenate(k) for k in kept))

    def unpacked(columns: list[list[bytes]]) -> list[np.ndarray]:
        return [np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, kind) for b in c)]) for c, kind in zip(columns, ("<u8", "<i4", "<i8"))]

    def rows_of(address: np.ndarray, tile: np.ndarray, name: np.ndarray) -> dict[str, pa.Array]:
        return {"address": pa.array(address.view(np.int64), pa.int64()), "tile": pa.array(tile, pa.int32()), "class": pa.array(name, pa.int64())}

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        address, tile, name = unpacked([table.column(c).to_pylist() for c in ("addresses", "tiles", "classes")])
        if key[0].as_py() >= buckets:
            return pa.table(rows_of(address, tile, name))
        _, own, count = np.unique(address, return_inverse=True, return_counts=True)
        several = np.flatnonzero(count[own] > 1)
        address, tile, name = address[several], tile[several], name[several]
        order = np.lexsort((name, address))
        address, tile, name = address[order], tile[order], name[order]
        fresh = np.ones(len(address), bool)
        fresh[1:] = (address[1:] != address[:-1]) | (name[1:] != name[:-1])
        address, tile, name = address[fresh], tile[fresh], name[fresh]
        _, own, count = np.unique(address, return_inverse=True, return_counts=True)
        several = count[own] > 1
        return pa.table(rows_of(address[several], tile[several], name[several]))

    sent = source.mapInArrow(send, "bucket int, addresses binary, tiles binary, classes binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "address long, tile int, class long")
    met = scratch(met.groupBy("address", "class").agg(F.first("tile").alias("tile")), "jaccard-met")
    sizes = met.groupBy("address").agg(F.count("*").alias("others"))
    return met.join(sizes, "address")


def blocks_of(size: Column) -> Column:
    """The number of blocks of a group: many for a group of medium size, which then is work for many tasks, while each
    block of a large one holds LARGE_BLOCK, as every row goes to every block of its group."""
    at_least = lambda n: F.ceil(size / F.lit(n)).cast("int")
    return F.greatest(F.least(at_least(BLOCK), F.lit(MOST_BLOCKS)), at_least(LARGE_BLOCK), F.lit(1))


def own_block(item: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(item), blocks).cast("int")


def in_blocks(rows: DataFrame, size: str, item: str) -> DataFrame:
    """rows with `block_a` and `block_b`: each pair of blocks of a group is a task of its own, so that no task holds a
    whole large group and yet all its pairs meet."""
    blocks = blocks_of(F.col(size))
    own = own_block(item, blocks)
    pairs = F.when(blocks <= 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b")))
    )
    return rows.withColumn("block_own", own).withColumn("_p", F.explode(pairs)).withColumns({"block_a": F.col("_p.a"), "block_b": F.col("_p.b")}).drop("_p")


def bitmap_links(shared: DataFrame, classes: DataFrame, tiles: Tiles, buckets: int) -> DataFrame:
    """(class, other, weight): links that join all classes whose bitmaps leave them similar at a shared address."""
    rows = shared.join(classes.select("class", "n_shingles", "bitmap"), "class")
    rows = in_blocks(rows, "others", "class")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("address", "block_a", "block_b"), F.lit(buckets)).cast("int"))
    rows = rows.select("bucket", "address", "block_a", "block_b", "tile", "class", "n_shingles", "bitmap")

    def compare(table: pa.Table) -> pa.Table:
        address = table.column("address").to_numpy()
        a, b = table.column("block_a").to_numpy().astype(np.int64), table.column("block_b").to_numpy().astype(np.int64)
        tile, name = table.column("tile").to_numpy(), table.column("class").to_numpy()
        size = table.column("n_shingles").to_numpy()
        maps = table.column("bitmap").to_pylist()
        names, item = np.unique(name, return_inverse=True)
        weight = np.bincount(item, minlength=len(names)).astype(np.int64)
        ones, twos = [], []
        for t in np.unique(tile):
            mine = np.flatnonzero(tile == t)
            bits = min(len(maps[i]) * 8 for i in mine)
            words = np.stack([folded(np.frombuffer(maps[i], "<u8"), bits) for i in mine])
            group = np.unique(np.stack([address[mine], a[mine], b[mine]]), axis=1, return_inverse=True)[1].ravel()
            order = np.argsort(group, kind="stable")
            cut = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
            many = np.diff(cut)
            # small groups: all pairs of all groups of one size at once
            for g in np.unique(many[many <= SMALL]):
                starts = cut[:-1][many == g]
                i, j = np.triu_indices(g, 1)
                for some in np.array_split(starts, max(1, len(starts) * len(i) * words.shape[1] // (1 << 20))):
                    x, y = order[(some[:, None] + i).ravel()], order[(some[:, None] + j).ravel()]
                    near = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= tiles.may_differ(size[mine[x]], size[mine[y]])
                    ones.append(item[mine[x[near]]])
                    twos.append(item[mine[y[near]]])
            for begin, length in zip(cut[:-1][many > SMALL], many[many > SMALL]):
                rest = order[begin : begin + length]
                forest = Forest(length)
                for p in range(length):
                    open_ = p + 1 + np.flatnonzero(forest.label[p + 1 :] != forest.label[p])
                    if not len(open_):
                        continue
                    differ = np.bitwise_count(words[rest[p]] ^ words[rest[open_]]).sum(axis=1, dtype=np.int64)
                    hit = open_[differ <= tiles.may_differ(size[mine[rest[p]]], size[mine[rest[open_]]])]
                    if len(hit):
                        forest.join(p, hit)
                        ones.append(np.full(len(hit), item[mine[rest[p]]]))
                        twos.append(item[mine[rest[hit]]])
        if not ones:
            label = np.arange(len(names))
            met = np.zeros(0, np.int64)
        else:
            one, two = np.concatenate(ones), np.concatenate(twos)
            label, met = joined(len(names), one, two), np.unique(np.concatenate([one, two]))
        return pa.Table.from_arrays(
            [pa.array(names[met], pa.int64()), pa.array(names[label[met]], pa.int64()), pa.array(weight[met], pa.int64())], names=["class", "other", "weight"]
        )

    return rows.groupBy("bucket").applyInArrow(compare, "class long, other long, weight long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b), for all nodes that have one.

    Every round each node takes the least label around it and then that label's own label, so paths shorten by
    doubling; rounds are written to the shared folder.
    """
    both = scratch(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-edges")
    labels = scratch(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), name)
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        new = labels.join(around, "node", "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("further"))
        new = new.join(up, "low", "left").select("node", "was", F.least("low", F.coalesce("further", "low")).alias("component"))
        new = scratch(new, name)
        discard(labels)
        if new.filter("was <> component").isEmpty():
            discard(both)
            return new.select("node", "component")
        labels = new.select("node", "component")


def by_pivot(body: DataFrame, tiles: Tiles) -> tuple[DataFrame, DataFrame]:
    """(class, near, left) of the classes of clusters of more than one block, and the exact links (a, b) of their pivots.

    A cluster's pivot is its most central class. `near` classes are similar to it; `left` is the number of the others
    in the cluster, which alone are still to be compared with all.
    """
    large = body.filter(F.col("in_cluster") > BLOCK).select("cluster", "class", "weight", "shingles")
    heads = large.groupBy("cluster").agg(F.max_by(F.struct("class", "shingles"), F.struct("weight", "class")).alias("p"))
    heads = heads.select("cluster", F.col("p.class").alias("pivot"), F.col("p.shingles").alias("other"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for one, two in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                x, y = np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8")
                near.append(bool(tiles.similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.bool_())], names=["cluster", "class", "pivot", "near"])

    met = large.join(heads, "cluster").select("cluster", "class", "pivot", "shingles", "other")
    met = scratch(met.mapInArrow(compare, "cluster long, class long, pivot long, near boolean"), "jaccard-pivots")
    left = met.groupBy("cluster").agg(F.count_if(~F.col("near")).alias("left"))
    links = met.filter("near AND class <> pivot").select(F.col("class").alias("a"), F.col("pivot").alias("b"))
    return met.join(left, "cluster").select("class", "near", "left"), links


def beside_pivot(body: DataFrame, flagged: DataFrame) -> DataFrame:
    """body in blocks, where `block_own` is 1 for classes that are to be compared with all of their cluster, else 0.

    A small cluster is one block. In a large one the classes that are not near the pivot are in blocks of their own,
    each of which meets every block of the cluster; a near class goes to as many tasks as there are such blocks.
    """
    rows = body.join(flagged, "class", "left").withColumn("block_own", F.coalesce((~F.col("near")).cast("int"), F.lit(1)))
    every, others = blocks_of(F.col("in_cluster")), F.when(F.col("left") > 0, blocks_of(F.col("left"))).otherwise(0)
    task = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    as_one = F.transform(span(others), lambda i: task(i, own_block("class", every)))
    as_other = F.when(F.col("block_own") == 1, F.transform(span(every), lambda j: task(own_block("class", others), j))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    tasks = F.when(F.col("near").isNull(), F.array(task(F.lit(0), F.lit(0)))).otherwise(F.array_distinct(F.concat(as_one, as_other)))
    return rows.withColumn("_p", F.explode(tasks)).withColumns({"block_a": F.col("_p.a"), "block_b": F.col("_p.b")}).drop("_p", "near", "left")


def exact_links(
    docs: DataFrame, n: int, text: str, doc_id: str, members: DataFrame, classes: DataFrame, tiles: Tiles, buckets: int, small: int, every: bool, pairs: bool
) -> DataFrame:
    """(a, b, linked, others): exact links (a, b) that join the similar classes of each cluster.

    With `every`, all similar pairs are found: over the rows of a class, `linked` adds up to the documents of other
    classes that it is similar to, and with `pairs` the lists `others` hold each pair of similar classes once.
    members: (class, cluster, weight, in_cluster, copies). Only one document of each member is read again for its
    shingles; a list of at most `small` of them is broadcast, a longer one is joined by shuffle.
    """
    wanted = members.join(classes.select("class", "rep"), "class").select(F.col("rep").alias("__rep")).distinct()
    few = members.count() <= small
    ids = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    ids = ids.join(F.broadcast(wanted) if few else wanted, F.col("__id").eqNullSafe(F.col("__rep")), "left_semi").select("__text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                found = [s for s in shingle_sets(data, offsets, n) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([class_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["class", "shingles"]
                )

    body = ids.mapInArrow(sets, "class long, shingles binary")
    body = body.join(F.broadcast(members) if few else members, "class").dropDuplicates(["class"])
    body = scratch(body, "jaccard-sets")
    pivots = None
    if every:
        rows = in_blocks(body, "in_cluster", "class")
    else:
        flagged, pivots = by_pivot(body, tiles)
        rows = beside_pivot(body, flagged)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("cluster", "block_a", "block_b"), F.lit(buckets)).cast("int"))
    rows = rows.select("bucket", "cluster", "block_a", "block_b", "class", "weight", "block_own", "copies", "shingles")
    none = np.zeros(0, np.int64)

    def compare(table: pa.Table) -> pa.Table:
        """Each task of the bucket in turn: the rows of one pair of blocks of one cluster."""
        cols = [table.column(c).to_numpy().astype(np.int64) for c in ("cluster", "block_a", "block_b", "class", "weight", "block_own", "copies")]
        body = table.column("shingles")
        order = np.lexsort(cols[2::-1])
        keys = np.stack([c[order] for c in cols[:3]])
        cut = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True])))
        a, b, linked, others = [none], [none], [none], []
        for start, end in zip(cut[:-1], cut[1:]):
            mine = order[start:end]
            at, one, two = similar_pairs(mine, cols[1][mine[0]] != cols[2][mine[0]], *cols[3:6], body)
            name, copies = cols[3][at], cols[6][at]
            if not every:
                a.append(name[one])
                b.append(name[two])
                continue
            met = np.unique(np.concatenate([one, two]))
            a.append(name[met])
            b.append(name[joined(len(at), one, two)[met]])
            linked.append((np.bincount(one, weights=copies[two], minlength=len(at)) + np.bincount(two, weights=copies[one], minlength=len(at)))[met].astype(np.int64))
            if pairs:
                span = np.searchsorted(one, met, side="left"), np.searchsorted(one, met, side="right")
                others += [name[two[x:y]] for x, y in zip(*span)]
        a = np.concatenate(a)
        return pa.Table.from_arrays(
            [
                pa.array(a, pa.int64()),
                pa.array(np.concatenate(b), pa.int64()),
                pa.array(np.concatenate(linked), pa.int64()) if every else pa.nulls(len(a), pa.int64()),
                pa.array(others, pa.list_(pa.int64())) if pairs else pa.nulls(len(a), pa.list_(pa.int64())),
            ],
            names=["a", "b", "linked", "others"],
        )

    def similar_pairs(
        rows_: np.ndarray, cross: bool, name: np.ndarray, weight: np.ndarray, side: np.ndarray, body: pa.ChunkedArray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of the task's classes, and the similar pairs as places in them, in order of the first. Two blocks
        are compared with each other only, as each has a task for its own pairs."""
        at = rows_[np.unique(name[rows_], return_index=True)[1]]
        at = at[np.lexsort((name[at], -weight[at]))]
        sets_ = [np.frombuffer(body[int(i)].as_py(), "<u8") for i in at]
        size = np.array([len(s) for s in sets_], np.int64)
        offsets = np.concatenate(([0], np.cumsum(size)))
        _, code = np.unique(np.concatenate(sets_), return_inverse=True)
        bits = min(width_of(int(size.min())), 4096)
        maps = np.stack([bitmap(s, bits) for s in sets_])
        mark = np.zeros(int(code.max()) + 1, bool)
        forest = Forest(len(at))
        if not every and (side[at] == 0).any():
            # these have met their cluster's pivot
            forest.label[side[at] == 0] = np.flatnonzero(side[at] == 0)[0]
        one, two = [none], [none]
        for p in range(len(at)):
            if every:
                open_ = p + 1 + np.flatnonzero(side[at[p + 1 :]] != side[at[p]]) if cross else np.arange(p + 1, len(at))
            else:
                open_ = p + 1 + np.flatnonzero((forest.label[p + 1 :] != forest.label[p]) & ((side[at[p + 1 :]] | side[at[p]]) == 1))
            most = tiles.may_differ(size[p], size[open_])
            near = np.abs(size[open_] - size[p]) <= most
            open_, most = open_[near], most[near]
            open_ = open_[np.bitwise_count(maps[p] ^ maps[open_]).sum(axis=1, dtype=np.int64) <= most]
            if not len(open_):
                continue
            mark[code[offsets[p] : offsets[p + 1]]] = True
            common = np.array([np.count_nonzero(mark[code[offsets[q] : offsets[q + 1]]]) for q in open_], np.int64)
            mark[code[offsets[p] : offsets[p + 1]]] = False
            hit = open_[tiles.similar(size[p], size[open_], common)]
            if len(hit):
                if not every:
                    forest.join(p, hit)
                one.append(np.full(len(hit), p))
                two.append(hit)
        return at, np.concatenate(one), np.concatenate(two)

    found = rows.groupBy("bucket").applyInArrow(compare, "a long, b long, linked long, others array<long>")
    return found if pivots is None else found.unionByName(pivots, allowMissingColumns=True)


def class_links(
    docs: DataFrame, n: int, tiles: Tiles, text: str, doc_id: str, rows: DataFrame, per_bucket: int, small: int, every: bool, pairs: bool
) -> tuple[DataFrame, DataFrame]:
    """The classes (class, rep, n_shingles, bitmap, copies) of described rows, and their exact links."""
    described_ = rows.filter("class IS NOT NULL").groupBy("class")
    classes = described_.agg(F.min("__doc").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bitmap").alias("bitmap"), F.count("*").alias("copies"))
    classes = scratch(classes, "jaccard-classes")
    buckets = max(128, classes.count() // per_bucket)
    shared = scratch(shared_addresses(docs, n, tiles, text, buckets), "jaccard-shared")
    # rows of blocks are several times the classes
    buckets *= 4
    may = bitmap_links(shared, classes, tiles, buckets)
    may = scratch(may, "jaccard-may")
    clusters = components(may.select(F.col("class").alias("a"), F.col("other").alias("b")), "jaccard-clusters")
    weight = may.groupBy(F.col("class").alias("node")).agg(F.sum("weight").alias("weight"))
    sizes = clusters.groupBy("component").agg(F.count("*").alias("in_cluster"))
    members = clusters.join(weight, "node", "left").join(sizes, "component").join(classes.select(F.col("class").alias("node"), "copies"), "node")
    members = scratch(
        members.select(F.col("node").alias("class"), F.col("component").alias("cluster"), F.coalesce("weight", F.lit(0)).alias("weight"), "in_cluster", "copies"),
        "jaccard-members",
    )
    return classes, scratch(exact_links(docs, n, text, doc_id, members, classes, tiles, buckets, small, every, pairs), "jaccard-links")


def jaccard_links(
    docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, text: str = "text", doc_id: str = "doc_id", per_bucket: int = 2000, small: int = 2_000_000
) -> DataFrame:
    """(class, other, id, other_id, copies, other_copies): each pair of different shingle sets of Jaccard >= num / den
    once, with the least ids of their documents and how many documents have them. Equal sets are one class."""
    tiles = Tiles(num, den)
    rows = docs.select(F.col(f"`{doc_id}`").alias("__doc"), F.col(f"`{text}`").alias("__body"))
    rows = scratch(described(rows, n, "__body", ["__doc"]), "jaccard-rows")
    classes, links = class_links(docs, n, tiles, text, doc_id, rows, per_bucket, small, True, True)
    found = links.select(F.col("a"), F.explode("others").alias("b")).select(F.least("a", "b").alias("class"), F.greatest("a", "b").alias("other"))
    one = classes.select("class", F.col("rep").alias("id"), "copies")
    two = classes.select(F.col("class").alias("other"), F.col("rep").alias("other_id"), F.col("copies").alias("other_copies"))
    return found.join(one, "class").join(two, "other").select("class", "other", "id", "other_id", "copies", "other_copies")


def jaccard_join(
    docs: DataFrame,
    n: int = 3,
    num: int = 90,
    den: int = 100,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: list[str] | None = None,
    per_bucket: int = 2000,
    small: int = 2_000_000,
    count_links: bool = True,
) -> DataFrame:
    """The kept columns with n_shingles, component_id, the least id reachable over links of Jaccard >= num / den, and
    n_links, the number of other documents (copies of its own text among them) to which the document has a link.

    Without count_links there is no n_links, and pairs that are in one component already are not compared.

    Shingles are n words (A-Z lower-cased, parted by whitespace); a text of fewer words is one shingle. Null texts and
    texts without words have none, and are components of their own. Ids may be repeated: each row is a document, and
    the least id of the rows reached counts. Null ids never name a component that has others. Repeated rows share
    their component. No rows give no rows. Of the kept columns (default: the id) those that clash are replaced.
    """
    tiles = Tiles(num, den)
    new = ("n_shingles", "component_id", "n_links") if count_links else ("n_shingles", "component_id")
    carried = [c for c in dict.fromkeys(keep if keep is not None else [doc_id]) if c.lower() not in new]
    inner = [f"__k{i}" for i in range(len(carried))]
    renamed = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(carried, inner)), F.col(f"`{doc_id}`").alias("__doc"), F.col(f"`{text}`").alias("__body"))
    rows = scratch(described(renamed, n, "__body", [*inner, "__doc"]), "jaccard-rows")
    classes, links = class_links(docs, n, tiles, text, doc_id, rows, per_bucket, small, count_links, False)
    parts = components(links, "jaccard-components")
    named = classes.select("class", "rep", "copies").join(parts, F.col("class") == F.col("node"), "left").withColumn("part", F.coalesce("component", "class"))
    least = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = named.select("class", "part", "copies").join(least, "part")
    if count_links:
        named = named.join(links.groupBy(F.col("a").alias("class")).agg(F.sum("linked").alias("linked")), "class", "left")
        named = named.withColumn("n_links", F.coalesce("linked", F.lit(0)) + F.col("copies") - 1)
    counted = ["n_links"] if count_links else []
    named = scratch(named.select(F.col("class").alias("_c"), "component_id", *counted), "jaccard-names")
    # rows without a class meet nothing, so they are not dealt by it; copies of one text are split by adaptive execution
    some = rows.filter("class IS NOT NULL").join(named, F.col("class") == F.col("_c"))
    out = some.unionByName(rows.filter("class IS NULL"), allowMissingColumns=True)
    return out.select(
        *(F.col(i).alias(c) for c, i in zip(carried, inner)),
        "n_shingles",
        F.when(F.col("class").isNull(), F.col("__doc")).otherwise(F.col("component_id")).alias("component_id"),
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counted),
    )
