"""Phrase collocations: phrases are counted level by level with double-array tries of Apriori-safe candidates.

A word is named by a 64-bit hash of its language and text. Words come first; a longer phrase is a candidate only if both
phrases that it has without its last and without its first word were frequent, which tasks look up in a bitmap of bounded
size (a bit set by chance lets a candidate in, never out). Candidates are dealt to blocks of bounded size; each block's
trie is broadcast, all positions of a stretch of text advance through it at once, one level after the other, and the
accepting states are counted and added up over the shards.

The trie is a double array: a state's children stand at base + code in one table, whose `check` names the parent and whose
`label` the word. A state with many children has several bases, chosen by other bits of the word, so that children find
free places quickly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, discard, mix64, runs, scratch, slices, slot, span_hashes

#: Bytes that end a piece, and those that only part words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True

#: Positions whose phrases are added up before they are handed on, and rows handed on at once.
SENT = 1 << 16
HELD = 1 << 20
#: Phrases of a block, and bits of a bitmap at most: about 50 MB and 16 MB.
BLOCK, MOST_BITS = 1 << 20, 1 << 27
#: Children of one base, as a mean, and places of the table for each child.
CHILDREN, ROOM = 4, 2
#: Parts of a language of which each gives its first rows before the language is ranked.
PARTS = 256
DEAD = -1


def lang_key(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang or "und").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def words_of(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and keys of the words of lower-cased bytes, and whether the next one follows in the piece. langs: a key a row."""
    starts, ends = runs(~APART[data])
    row = np.searchsorted(offsets, starts, side="right") - 1
    keys = mix64(span_hashes(data, starts, ends) ^ langs[row])
    breaks = np.cumsum(BREAK[data], dtype=np.int64)
    follows = np.zeros(len(starts), bool)
    follows[:-1] = breaks[starts[1:]] == breaks[ends[:-1] - 1]
    return starts, ends, keys, follows


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Lower-cased bytes, starts, ends, keys, follows and each word's language, stretch by stretch."""
    for batch in batches:
        names = batch.column("lang").to_pylist()
        keys = np.array([lang_key(v) for v in names], np.uint64) if names else np.zeros(0, np.uint64)
        for first, last, data, offsets in slices(batch.column("text")):
            data = LOWER[data]
            yield data, *words_of(data, offsets, keys[first:last]), (offsets, names[first:last])


def phrase_keys(keys: np.ndarray, follows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of the k words from each position on, and whether there are so many in the piece."""
    n = max(0, len(keys) - k + 1)
    out, whole = keys[:n].copy(), np.ones(n, bool)
    for j in range(1, k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + keys[j : n + j])
        whole &= follows[j - 1 : n + j - 1]
    return out, whole


def _added(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and sum of each distinct key."""
    order = np.argsort(key)
    cut = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else np.zeros(0, np.int64)
    return order[cut], np.add.reduceat(n[order], cut) if len(cut) else np.zeros(0, np.int64)


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, key, n), each word once a stretch."""
    for data, starts, ends, keys, _, (offsets, names) in _stretches(batches):
        at, n = _added(keys, np.ones(len(keys), np.int64))
        size = ends[at] - starts[at]
        into = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=into[1:])
        text = data[np.arange(into[-1]) - np.repeat(into[:-1] - starts[at], size)]
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(into), pa.py_buffer(np.ascontiguousarray(text))).cast(pa.string())
        row = np.searchsorted(offsets, starts[at], side="right") - 1
        langs = pa.array([v if v is not None else "und" for v in names], pa.string()).take(pa.array(row))
        yield pa.RecordBatch.from_arrays([langs, words, pa.array(keys[at].view(np.int64)), pa.array(n)], names=["lang", "word", "key", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, key, n) of all words of docs (lang, text)."""
    each = docs.mapInArrow(_counted_words, "lang string, word string, key long, n long")
    return each.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def _names(k: int) -> list[str]:
    return [f"h{j + 1}" for j in range(k)]


def _packed(table: pa.Table) -> pa.Table:
    """One block of a bitmap."""
    block = table.column("block")[0].as_py()
    own = np.zeros(1 << 16, np.uint8)
    own[table.column("at").to_numpy() & 0xFFFF] = 1
    return pa.table({"block": [block], "bits": [np.packbits(own).tobytes()]})


def bitmap(keys: DataFrame, rows: int) -> np.ndarray:
    """Bits, at the places that the keys' (`key`, of `rows` rows) hashes name; 2 MB to 16 MB, whatever the number of keys."""
    bits = 1 << max(24, min(MOST_BITS, 16 * max(1, rows)).bit_length() - 1)
    at = keys.select(F.col("key").bitwiseAND(bits - 1).alias("at")).distinct()
    packed = at.withColumn("block", F.shiftright("at", 16)).groupBy("block").applyInArrow(_packed, "block long, bits binary")
    out = np.zeros(bits >> 3, np.uint8)
    for r in packed.toLocalIterator():
        out[r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return out


def has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0


def _safe(k: int, held: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, ..., hk, n): phrases of k words whose first and last k - 1 words have their bits."""
    bits = held.value

    def handed(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(parts, axis=1)
        parts.clear()
        at, n = _added(phrase_of(rows), np.ones(rows.shape[1], np.int64))
        for a in range(0, len(at), SENT):
            yield _rows(k, rows[:, at[a : a + SENT]], n[a : a + SENT])

    parts, size = [], 0
    for _, _, _, keys, follows, _ in _stretches(batches):
        less, _ = phrase_keys(keys, follows, k - 1)
        own, n = has_bit(bits, less), max(0, len(keys) - k + 1)
        _, whole = phrase_keys(keys, follows, k)
        at = np.flatnonzero(whole & own[:n] & own[1 : n + 1])
        parts.append(np.stack([keys[at + j] for j in range(k)]))
        size += len(at)
        if size >= HELD:
            yield from handed(parts)
            size = 0
    if size:
        yield from handed(parts)


def phrase_of(words: np.ndarray) -> np.ndarray:
    """phrase_keys of phrases told as columns of words."""
    out = words[0].copy()
    for row in words[1:]:
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + row)
    return out


def _rows(k: int, words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(words[j].view(np.int64)) for j in range(k)), pa.array(n)], names=[*_names(k), "n"])


class Trie:
    """A double-array trie of phrases, told as columns of k word keys."""

    def __init__(self, phrases: np.ndarray):
        k, n = phrases.shape
        phrases = phrases[:, np.lexsort(phrases[::-1])]
        parents, symbols, before, count = [], [], np.zeros(n, np.int64), 1
        changed = np.zeros(n, bool)
        if n:
            changed[0] = True
        for j in range(k):
            changed[1:] |= phrases[j, 1:] != phrases[j, :-1]
            own = np.cumsum(changed) - 1 + count
            parents.append(before[changed])
            symbols.append(phrases[j][changed])
            before, count = own, count + int(changed.sum())
        parent, symbol = np.concatenate(parents), np.concatenate(symbols)
        edges = len(parent)
        self.k, self.size = k, 1 << max(4, (ROOM * edges).bit_length())
        children = np.bincount(parent, minlength=count)
        groups = np.ones(count, np.int64)
        groups[children > 0] = 1 << np.ceil(np.log2(np.maximum(1, children[children > 0] / CHILDREN))).astype(np.int64)
        groups[children == 0] = 0
        offset = np.cumsum(groups) - groups
        for self.salt in range(1, 1000):
            code = mix64(symbol + np.uint64(self.salt))
            group = offset[parent] + ((code >> np.uint64(40)).astype(np.int64) & (groups[parent] - 1))
            code = (code & np.uint64(self.size - 1)).astype(np.int64)
            # equal codes at one base could never be told apart
            if len(np.unique(group * self.size + code)) == edges:
                break
        else:
            raise ValueError("no salt parts the children of each base")
        self.base = self._placed(group, code, int(groups.sum()))
        place = (self.base[group] + code) & (self.size - 1)
        state = np.concatenate(([self.size], place))  # of each node; the root stands after the table
        self.check = np.full(self.size + 1, DEAD, np.int32)
        self.label = np.zeros(self.size + 1, np.uint64)
        self.check[place], self.label[place] = state[parent], symbol
        self.offset, self.mask = np.zeros(self.size + 1, np.int32), np.zeros(self.size + 1, np.int32)
        self.offset[state], self.mask[state] = np.minimum(offset, max(0, len(self.base) - 1)), np.maximum(0, groups - 1)

    def _placed(self, group: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        """A base for each group so that no two children share a place; groups with many children go first."""
        rng, base = np.random.default_rng(11), np.zeros(max(1, n), np.int32)
        used = np.zeros(self.size, bool)
        size = np.bincount(group, minlength=len(base))
        order = np.argsort(group, kind="stable")
        begin = np.cumsum(size) - size
        for one in sorted(set(size[size > 0].tolist()), reverse=True):
            left = np.flatnonzero(size == one)
            codes = code[order[begin[left][:, None] + np.arange(one)]]
            while len(left):
                tried = rng.integers(0, self.size, len(left))
                at = (tried[:, None] + codes) & (self.size - 1)
                free = np.flatnonzero(~used[at].any(axis=1))
                # of those that want the same place the first has it
                owner = np.full(self.size, -1, np.int64)
                owner[at[free][::-1]] = free[::-1][:, None]
                won = free[(owner[at[free]] == free[:, None]).all(axis=1)]
                used[at[won]] = True
                base[left[won]] = tried[won]
                stay = np.ones(len(left), bool)
                stay[won] = False
                left, codes = left[stay], codes[stay]
        return base

    def advance(self, state: np.ndarray, words: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one more word each; DEAD where there is none. codes: mix64(words + salt)."""
        group = self.offset[state] + ((codes >> np.uint64(40)).astype(np.int64) & self.mask[state])
        to = (self.base[group] + (codes & np.uint64(self.size - 1)).astype(np.int64)) & (self.size - 1)
        return np.where((self.check[to] == state) & (self.label[to] == words), to, DEAD)

    def accepted(self, words: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """The accepting states of all positions: every position takes one level, and those that are left the next."""
        codes = mix64(words + np.uint64(self.salt))
        at = np.arange(len(words))
        state = np.full(len(words), self.size, np.int64)
        for j in range(self.k):
            if j:
                ok = at + j < len(words)
                at, state = at[ok], state[ok]
                ok = follows[at + j - 1]
                at, state = at[ok], state[ok]
            state = self.advance(state, words[at + j], codes[at + j])
            alive = state != DEAD
            at, state = at[alive], state[alive]
        return state

    def phrases(self, states: np.ndarray) -> np.ndarray:
        """The words that lead to the states."""
        out = []
        for _ in range(self.k):
            out.append(self.label[states])
            states = self.check[states]
        return np.stack(out[::-1])


def _matched(held: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, ..., hk, n): how often a shard has each phrase of the trie."""
    trie = held.value
    total = np.zeros(trie.size, np.int64)
    for _, _, _, keys, follows, _ in _stretches(batches):
        if len(keys):
            total += np.bincount(trie.accepted(keys, follows), minlength=trie.size)
    states = np.flatnonzero(total)
    for at in range(0, len(states), SENT):
        some = states[at : at + SENT]
        yield _rows(trie.k, trie.phrases(some), total[some])


def count_phrases(docs: DataFrame, k: int, shorter: DataFrame, rows: int, least: int, block: int = BLOCK) -> DataFrame:
    """(h1, ..., hk, n) of the phrases of k words that stand at least `least` times.

    shorter: `key` of each frequent phrase of k - 1 words, of which there are `rows`. A phrase whose safe occurrences add
    up to less than `least` is no candidate; the candidates' blocks are searched one after the other, so only one trie
    is held at a time, whatever their number.
    """
    spark, names = docs.sparkSession, _names(k)
    schema = ", ".join(f"{h} long" for h in [*names, "n"])
    bits = spark.sparkContext.broadcast(bitmap(shorter, rows))
    safe = docs.mapInArrow(partial(_safe, k, bits), schema).groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select(*names)
    safe = scratch(safe, f"phrases-{k}-safe")
    blocks = max(1, -(-safe.count() // block))
    parted = safe.withColumn("block", F.pmod(F.xxhash64(*names), F.lit(blocks)))
    whole = None
    for b in range(blocks):
        own = parted.filter(F.col("block") == b).select(*names).toArrow()
        trie = spark.sparkContext.broadcast(Trie(np.stack([own.column(h).to_numpy().view(np.uint64) for h in names])))
        found = docs.mapInArrow(partial(_matched, trie), schema).groupBy(*names).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        found = scratch(found, f"phrases-{k}")
        whole = found if whole is None else whole.unionByName(found)
        trie.destroy()
    bits.destroy()
    discard(safe)
    return whole


def _keys_of(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = np.stack([batch.column(h).to_numpy().view(np.uint64) for h in _names(k)])
        yield pa.RecordBatch.from_arrays([pa.array(phrase_of(words).view(np.int64))], names=["key"])


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, first: int = 2000, inside: int = 50, lang: str = "lang", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score, a and text.

    A-Z are lower-cased; a null text is empty and a null language `und`. A phrase of 2 to `longest` words with a >= least
    is a candidate; cut after k words into parts with l and r occurrences it scores floor(1000000 a a / (l r)), and the cut
    with the least score counts (ties: the first). A candidate inside a longer one with 100 f >= inside * a is dropped.
    Repeated rows count each; no rows give no rows; other columns of docs are not looked at.
    """
    docs = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    every = scratch(count_words(docs), "phrase-words")
    sizes = every.groupBy("lang").agg(F.sum("n").alias("size"))
    words = scratch(every.filter(F.col("n") >= least).withColumnRenamed("key", "h1"), "phrases-1")
    found = {1: words.select("h1", "n")}
    shorter, rows = words.select(F.col("h1").alias("key")), words.count()
    for k in range(2, longest + 1):
        found[k] = count_phrases(docs, k, shorter, rows, least, block)
        rows = found[k].count()
        shorter = found[k].select(*_names(k)).mapInArrow(partial(_keys_of, k), "key long")

    out = None
    for k in range(2, longest + 1):
        own, names = found[k].withColumnRenamed("n", "a"), _names(k)
        for j in range(1, k):
            for part, at in (("l", names[:j]), ("r", names[j:])):
                other = found[len(at)].select(*(F.col(h).alias(f"_{h}") for h in _names(len(at))), F.col("n").alias(f"{part}{j}"))
                on = [F.col(h) == F.col(f"_{o}") for h, o in zip(at, _names(len(at)))]
                own = own.join(other, on).drop(*(f"_{o}" for o in _names(len(at))))
        score = lambda j: F.expr(f"(cast(1000000 as decimal(38,0)) * a * a) div (cast(l{j} as decimal(19,0)) * cast(r{j} as decimal(19,0)))")
        cut = F.array_min(F.array(*(F.struct(score(j).cast("long").alias("score"), F.lit(j).alias("k"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")) for j in range(1, k))))
        own = own.select(*names, "a", cut.alias("cut"))
        # the most frequent longer candidate around each
        around = None
        for m in range(k + 1, longest + 1):
            for at in range(m - k + 1):
                some = found[m].select(*(F.col(f"h{at + j + 1}").alias(f"_h{j + 1}") for j in range(k)), F.col("n").alias("f"))
                around = some if around is None else around.unionByName(some)
        if around is not None:
            most = around.groupBy(*(f"_{h}" for h in names)).agg(F.max("f").alias("f"))
            own = own.join(most, [F.col(h) == F.col(f"_{h}") for h in names], "left").filter(F.col("f").isNull() | (100 * F.col("f") < inside * F.col("a")))
        for j in range(k):
            text_of = words.select(F.col("h1").alias("_h"), F.col("word").alias(f"w{j + 1}"), *([F.col("lang")] if j == 0 else []))
            own = own.join(text_of, F.col(names[j]) == F.col("_h")).drop("_h")
        own = own.select("lang", F.concat_ws(" ", *(f"w{j + 1}" for j in range(k))).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        out = own if out is None else out.unionByName(own)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # parts of a language give their first rows, and only those are ranked together
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    out = out.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= first)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return out.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("size").alias("n"), "score")
