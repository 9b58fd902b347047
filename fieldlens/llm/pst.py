"""Language-model scoring by a probabilistic suffix tree over a text's tokens.

Tokens are the lower-cased words and one end. A context is the word before a token, told apart exactly, and up to three
symbols before that word; a symbol is a frequent word, a class of other words by their last two bytes, or the start. So
contexts grow with the vocabulary and with the corpus. A context is kept where a divergence test tells its next-symbol
distribution from that of its suffix, or where a longer kept one needs it. Each distribution is smoothed by its
suffix's. A token has its symbol's probability in the state of its longest kept context, times its add-one probability
among the words of its symbol.

The tree is never gathered: its branches (first word of the context) are dealt over tasks, each of which counts, tests
and scores its own branches, and answers with sums for the rows that asked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, dealt, discard, mix64, runs, scratch, slices, slot, span_hashes

SYMBOLS, END, FREQUENT = 256, 0, 127
#: Symbols of a context beyond its word.
FARTHER = 3
DEPTH = 1 + FARTHER
#: Words that a task counts before it sends them.
HELD_WORDS = 1 << 19
#: Entries of branches that a task scores at once (more only where one branch has them).
HELD_ENTRIES = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CLASS_OF_END = (FREQUENT + 1 + (mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) >> np.uint64(57)).astype(np.int64)).astype(np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all words, and the offsets of the rows in them."""
    starts, ends = runs(NOT_SPACE[data])
    low = LOWER[data]
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    classes = _CLASS_OF_END[before << 8 | low[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    return np.maximum(span_hashes(low, starts, ends), np.uint64(1)), classes, np.searchsorted(starts, offsets)


@dataclass
class Alphabet:
    """What all tasks know: the frequent words, sorted, with their counts, totals, and the first level of the tree.

    seen[x] and kinds[x] are the training tokens and distinct words of each symbol; first[s] is the smoothed next-symbol
    distribution after the start (0) and each frequent word (1 and on). start[x] is the whole branch of the start: the log10
    probability of x as a text's first symbol.
    """

    words: np.ndarray
    counts: np.ndarray
    seen: np.ndarray
    kinds: np.ndarray
    rows: int
    first: np.ndarray
    start: np.ndarray

    @property
    def root(self) -> np.ndarray:
        whole = self.seen + 1.0
        return whole / whole.sum()

    def symbols(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return classes
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, classes).astype(np.uint8)


def count_words(docs: DataFrame, held: Column, text: str, bucket_bytes: int) -> tuple[Alphabet, int]:
    """The alphabet without its first level, and the bytes of all texts.

    Every training word is counted: tasks add up and send packed arrays to the word's bucket; a bucket answers with the
    totals of each class and its most frequent words, among which are those of the corpus.
    """
    source = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    rows, size = source.agg(F.count_if(~F.col("held")), F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()
    buckets = max(64, -(-size // bucket_bytes))

    def packed(words: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        each = [(b, words[i].tobytes(), classes[i].astype(np.uint8).tobytes(), counts[i].astype("<u4").tobytes()) for b, i in dealt(slot(words, buckets))]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*each), kinds)], names=["bucket", "words", "classes", "counts"])

    def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, classes, counts = (np.concatenate([p[k] for p in parts]) for k in range(3))
        distinct, at, index = np.unique(words, return_index=True, return_inverse=True)
        return distinct, classes[at], np.bincount(index, weights=counts, minlength=len(distinct)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                hashes, classes, _ = words_of(data, offsets)
                parts.append(merged([(hashes, classes, np.ones(len(hashes)))]))
                waiting += len(parts[-1][0])
                if waiting > HELD_WORDS:
                    parts = [merged(parts)]
                    waiting = 0
                    if len(parts[0][0]) > HELD_WORDS:
                        yield packed(*parts[0])
                        parts = []
        if parts and len((one := merged(parts))[0]):
            yield packed(*one)

    def most(key: tuple, table: pa.Table) -> pa.Table:
        body = [[np.frombuffer(b, kind) for b in table.column(c).to_pylist()] for c, kind in (("words", "<u8"), ("classes", "u1"), ("counts", "<u4"))]
        word, cls, n = merged(list(zip(*body)))
        top = np.lexsort((word.view(np.int64), -n))[:FREQUENT]
        some = np.flatnonzero(np.bincount(cls, minlength=SYMBOLS))
        seen, kinds = np.bincount(cls, weights=n, minlength=SYMBOLS), np.bincount(cls, minlength=SYMBOLS)
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate([word[top].view(np.int64), np.full(len(some), 0)]), pa.int64()),
                pa.array(np.concatenate([cls[top], some]), pa.int32()),
                pa.array(np.concatenate([n[top], seen[some].astype(np.int64)]), pa.int64()),
                pa.array(np.concatenate([np.full(len(top), 0), kinds[some]]), pa.int64()),
            ],
            names=["word", "class", "n", "kinds"],
        )

    sent = source.filter(~F.col("held")).select("text").mapInArrow(count, "bucket int, words binary, classes binary, counts binary")
    # one answer for each bucket: at most FREQUENT words and 128 classes, added up before they reach the driver
    answers = scratch(sent.groupBy("bucket").applyInArrow(most, "word long, class int, n long, kinds long"), "pst-words")
    top = answers.filter("word <> 0").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    totals = answers.filter("word = 0").groupBy("class").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect()
    discard(answers)
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    counts = np.array([r["n"] for r in top], np.int64)
    seen, kinds = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
    for r in totals:
        seen[r["class"]], kinds[r["class"]] = r["n"], r["kinds"]
    for r in top:
        seen[r["class"]] -= r["n"]
        kinds[r["class"]] -= 1
    seen[1 : len(top) + 1], kinds[1 : len(top) + 1] = counts[order], 1
    seen[END], kinds[END] = rows, int(rows > 0)
    return Alphabet(words[order], counts[order], seen, kinds, rows, np.zeros((FREQUENT + 1, SYMBOLS)), np.zeros(SYMBOLS)), size


def streams(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token (words and end, row by row): row, code of farther symbols and next symbol, and the word before it
    (its place, -1 at the start). A code has the nearer symbols in the higher bytes; beyond the start they are 0."""
    rows = len(offsets) - 1
    many = np.diff(offsets) + 1
    row = np.repeat(np.arange(rows), many)
    place = np.arange(len(row)) - row
    first = (np.cumsum(many) - many)[row]
    nth = np.arange(len(row)) - first
    last = nth == many[row] - 1
    padded = np.append(symbols, np.uint8(END))
    code = np.where(last, END, padded[np.minimum(place, len(symbols))]).astype(np.uint32)
    for k in range(2, DEPTH + 1):
        far = np.where(nth >= k, padded[np.maximum(place - k, 0)], END).astype(np.uint32)
        code |= far << np.uint32(8 * (DEPTH - k + 1))
    return row, code, np.where(nth > 0, place - 1, -1)


def first_level(docs: DataFrame, held: Column, text: str, alphabet: Alphabet) -> None:
    """Sets the smoothed next-symbol distributions after the start and each frequent word, from all training tokens, and
    the branch of the start: nothing stands before it, so its first level has all of its counts."""
    sent = docs.sparkSession.sparkContext.broadcast(alphabet)
    source = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(held, F.lit(False)).alias("held")).filter(~F.col("held")).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FREQUENT + 1) * SYMBOLS, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                hashes, classes, at = words_of(data, offsets)
                symbols = sent.value.symbols(hashes, classes)
                _, code, word = streams(symbols, at)
                before = np.where(word >= 0, np.append(symbols, np.uint8(END))[word], END).astype(np.int64)
                own = before <= FREQUENT
                total += np.bincount(before[own] << 8 | (code[own] & np.uint32(255)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["cell", "n"])

    counts = np.zeros((FREQUENT + 1) * SYMBOLS)
    for r in source.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(-1, SYMBOLS)
    kinds = np.maximum((counts > 0).sum(axis=1, keepdims=True), 1)
    alphabet.first = (counts + kinds * alphabet.root) / (counts.sum(axis=1, keepdims=True) + kinds)
    alphabet.start, _ = branch_scores(np.zeros(SYMBOLS, np.int32), np.arange(SYMBOLS, dtype=np.uint32), counts[0], np.zeros(1, np.int64), alphabet)


def passes(ratio: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The divergence test: does twice the log-likelihood ratio exceed a high quantile of chi-squared."""
    free = np.maximum(kinds - 1, 1)
    return 2 * ratio > free + 3 * np.sqrt(2 * free) + 6


def branch_scores(branch: np.ndarray, code: np.ndarray, n: np.ndarray, named: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """For distinct (branch, code), sorted: log10 probability of the next symbol in the longest kept context; and the
    training tokens of each branch.

    n: training counts of the entries. named: for each branch the symbol of a frequent word or the start (0), whose first
    level is known, or -1. Level by level, entries that agree in their nearer symbols are added up; a context's
    distribution is (count + kinds * suffix's) / (total + kinds). A context is kept if it diverges from its suffix or
    one of its extensions is kept.
    """
    nxt = code.astype(np.uint8)
    total = np.bincount(branch, weights=n, minlength=len(named))
    key = branch.astype(np.uint64) << np.uint64(32) | code.astype(np.uint64)
    # from the longest contexts to the branch alone: each entry's context, count, symbol and entry of the next level
    levels = []
    for level in range(DEPTH, 0, -1):
        context, own = np.unique(key >> np.uint64(8), return_inverse=True)
        levels.append({"own": own.astype(np.int32), "contexts": context, "n": n, "next": nxt})
        if level > 1:
            shorter = (key >> np.uint64(16)) << np.uint64(8) | nxt.astype(np.uint64)
            key, up = np.unique(shorter, return_inverse=True)
            n = np.bincount(up, weights=n, minlength=len(key))
            nxt = key.astype(np.uint8)
            levels[-1]["up"] = up.astype(np.int32)
    root = alphabet.root
    for k in range(DEPTH - 1, -1, -1):
        a = levels[k]
        parent = root[a["next"]] if k == DEPTH - 1 else levels[k + 1]["q"][a["up"]]
        size = len(a["contexts"])
        whole = np.bincount(a["own"], weights=a["n"], minlength=size)
        kinds = np.bincount(a["own"], weights=a["n"] > 0, minlength=size)
        with np.errstate(divide="ignore", invalid="ignore"):
            each = np.where(a["n"] > 0, a["n"] * np.log(a["n"] / whole[a["own"]] / parent), 0.0)
        a["kept"] = passes(np.bincount(a["own"], weights=each, minlength=size), kinds) & (whole > 0)
        w, z = whole[a["own"]], kinds[a["own"]]
        a["q"] = np.where(w > 0, (a["n"] + z * parent) / np.maximum(w + z, 1), parent)
        if k == DEPTH - 1:
            sign = named[a["contexts"].astype(np.int64)]
            a["q"] = np.where(sign[a["own"]] >= 0, alphabet.first[np.maximum(sign, 0)[a["own"]], a["next"]], a["q"])
            a["kept"] |= sign >= 0
    # contexts of this level that a kept longer one needs
    for k in range(DEPTH - 1):
        longer, a = levels[k], levels[k + 1]
        needs = np.zeros(len(a["contexts"]), bool)
        needs[a["own"][longer["up"]][longer["kept"][longer["own"]]]] = True
        a["kept"] |= needs
    # from the branch outwards: the longest kept context decides
    best = None
    for k in range(DEPTH - 1, -1, -1):
        a = levels[k]
        shorter = root[a["next"]] if best is None else best[a["up"]]
        best = np.where(a["kept"][a["own"]], a["q"], shorter)
    return np.log10(best), total


def score_texts(
    docs: DataFrame, held: Column, text: str = "text", keep: list[str] | None = None, block_bytes: int = 8 << 20, bucket_bytes: int = 24 << 20
) -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score and score.

    held: a boolean column, true for rows to be scored only. Null and empty texts have the end token only. n_known
    counts tokens seen in training; base_score is the add-one unigram model's log10 probability of the tokens, score
    the tree's. Repeated rows count and are scored each; no rows give no rows; where nothing is
    learned, probabilities come from smoothing alone. `keep` (default: all but the text) names the columns to carry;
    those that clash with new ones are replaced. docs should be a table that is read, whose rows come in the same order
    if a lost task runs again.

    Words are told apart by 64-bit hashes. First tokens are scored where they are read. Blocks of about block_bytes of text send each branch's bucket their distinct
    (row, word, code) with the number of times; a frequent word's branch is dealt by its next farther symbol as well,
    and the first level of such a branch is the same for all tasks. A bucket sends each block back the sums for its
    rows. A window that is repeated, even a third of all, is one entry a row.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    carried = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text]) if c.lower() not in new]
    alphabet, size = count_words(docs, held, text, 64 << 20)
    first_level(docs, held, text, alphabet)
    sent = docs.sparkSession.sparkContext.broadcast(alphabet)
    buckets = max(64, -(-size // bucket_bytes))
    vocabulary, n_all = int(alphabet.kinds.sum()), int(alphabet.seen.sum())
    within = np.log10(alphabet.seen + alphabet.kinds + 1.0)
    source = docs.select(F.col(f"`{text}`").alias("__text"), F.coalesce(held, F.lit(False)).alias("__held"), *(F.col(f"`{c}`") for c in carried))
    spool = "bucket int, block string, row binary, branch binary, code binary, times binary, train binary, own binary, carried binary"
    fields = [f.split()[0] for f in spool.split(", ")]
    kinds = [pa.int32(), pa.string()] + [pa.binary()] * 7

    def block_rows(block: str, parts: list[tuple], batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        model = sent.value
        shift = np.cumsum([0] + [len(p[3]) for p in parts])
        row, word, code, train, own = (np.concatenate([p[k] for p in parts]) for k in range(5))
        row = row + np.repeat(shift[:-1], [len(p[0]) for p in parts])
        # one entry for each distinct (row, word, code), in the order of the rows
        _, at, times = np.unique(mix64(mix64(word + row.astype(np.uint64) * _ODD) + code.astype(np.uint64) * _ODD), return_index=True, return_counts=True)
        order = np.argsort(at)
        at, times = at[order], times[order]
        row, word, code = row[at], word[at], code[at]
        symbol = model.symbols(word, np.full(len(word), 255, np.uint8))
        far = np.where(symbol <= FREQUENT, mix64(word + (code >> np.uint32(24)).astype(np.uint64) * _ODD), word)
        home = zlib.crc32(block.encode()) % buckets
        out = []
        for b, at in dealt(slot(mix64(far), buckets)):
            distinct, index = np.unique(word[at], return_inverse=True)
            some, mine = np.unique(row[at], return_counts=True)
            head = np.stack([some, mine]).astype("<u4")
            out.append([b, block, head.tobytes(), distinct.tobytes() + index.astype("<u4").tobytes(), code[at].astype("<u4").tobytes(), times[at].astype("<u4").tobytes(), train[some].tobytes(), None, None])
        table = pa.Table.from_batches(batches)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        out.append([home, block, None, None, None, None, None, own.astype("<f8").tobytes(), sink.getvalue().to_pybytes()])
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=fields)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, context = sent.value, TaskContext.get()
        task = context.partitionId() if context else 0
        parts, rows, size, nth = [], [], 0, 0
        for batch in batches:
            train = ~np.array(batch.column(1).to_pylist(), bool)
            extra = batch.select(range(2, batch.num_columns)) if carried else batch.select([1])
            for a, b, data, offsets in slices(batch.column(0)):
                hashes, classes, at = words_of(data, offsets)
                symbols = model.symbols(hashes, classes)
                row, code, word = streams(symbols, at)
                later = word >= 0
                # what this task knows of a row: tokens, sums over its words within their symbols, and over frequent words,
                # and its first token, which asks no branch: each row has one
                owner = np.repeat(np.arange(b - a), np.diff(at))
                named = symbols <= FREQUENT
                count = np.append(0, model.counts)[np.where(named, symbols, 0)]
                logs = np.bincount(owner[named], weights=np.log10(count[named] + 1.0), minlength=b - a)
                own = np.stack([np.diff(at) + 1.0, np.bincount(owner, weights=within[symbols], minlength=b - a), logs, np.bincount(owner[named], weights=count[named] > 0, minlength=b - a), model.start[code[~later] & np.uint32(255)]], axis=1)
                parts.append((row[later], hashes[word[later]], code[later], train[a:b], own))
                rows.append(extra.slice(a, b - a))
                size += len(data)
                if size >= block_bytes:
                    yield block_rows(f"{task}.{nth}", parts, rows)
                    parts, rows, size, nth = [], [], 0, nth + 1
        if size:
            yield block_rows(f"{task}.{nth}", parts, rows)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        model = sent.value
        asks = table.filter(pc.is_valid(table.column("row")))
        homes = table.filter(pc.is_valid(table.column("own")))
        blocks = asks.column("block").to_pylist()
        heads = [np.frombuffer(x, "<u4").reshape(2, -1) for x in asks.column("row").to_pylist()]
        codes = [np.frombuffer(x, "<u4") for x in asks.column("code").to_pylist()]
        times = np.concatenate([np.zeros(0, np.uint32)] + [np.frombuffer(x, "<u4") for x in asks.column("times").to_pylist()])
        train = np.concatenate([np.zeros(0, bool)] + [np.repeat(np.frombuffer(t, bool), h[1]) for t, h in zip(asks.column("train").to_pylist(), heads)])
        words, at, base = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for body, c in zip(asks.column("branch").to_pylist(), codes):
            words.append(np.frombuffer(body, "<u8", (len(body) - 4 * len(c)) // 8))
            at.append(np.frombuffer(body, "<u4", len(c), 8 * len(words[-1])).astype(np.int64) + base)
            base += len(words[-1])
        branch, of = np.unique(np.concatenate(words), return_inverse=True)
        place = of[np.concatenate(at)].astype(np.int32) if len(of) else np.zeros(0, np.int32)
        code = np.concatenate([np.zeros(0, np.uint32), *codes])
        del at, codes
        symbol = model.symbols(branch, np.full(len(branch), 255, np.uint8)).astype(np.int64)
        named = np.where(symbol <= FREQUENT, symbol, -1)
        logs, base_logs, known = np.zeros(len(code)), np.zeros(len(code)), np.zeros(len(code), bool)
        # branches know nothing of each other: a few at a time are held
        many = np.cumsum(np.bincount(place, minlength=len(branch)))
        for _, some in dealt((many // HELD_ENTRIES)[place]) if len(code) else ():
            low = int(place[some].min())
            keys, index = np.unique((place[some] - low).astype(np.uint64) << np.uint64(32) | code[some], return_inverse=True)
            own = (keys >> np.uint64(32)).astype(np.int32)
            n = np.bincount(index, weights=np.where(train[some], times[some], 0), minlength=len(keys))
            sign = named[low : low + int(own.max()) + 1]
            found, total = branch_scores(own, keys.astype(np.uint32), n, sign, model)
            rare = sign < 0
            logs[some] = found[index]
            base_logs[some] = np.where(rare, np.log10(total + 1.0), 0.0)[own[index]]
            known[some] = (rare & (total > 0))[own[index]]
        cut = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64)] + [h[1].astype(np.int64) for h in heads]))])
        sums = [np.add.reduceat(np.append(times * v, 0.0), cut[:-1]) if len(cut) > 1 else np.zeros(0) for v in (logs, base_logs, known)]
        each = np.cumsum([0] + [h.shape[1] for h in heads])
        out = [[name, h[0].tobytes(), np.stack([s[a:b] for s in sums]).astype("<f8").tobytes(), None, None] for name, h, a, b in zip(blocks, heads, each[:-1], each[1:])]
        out += [[r["block"], None, None, r["own"], r["carried"]] for r in homes.select(["block", "own", "carried"]).to_pylist()]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], pa.string() if i == 0 else pa.binary()) for i in range(5)], names=["block", "row", "sums", "own", "carried"])

    asked = source.mapInArrow(ask, spool)
    answers = asked.groupBy("bucket").applyInArrow(answer, "block string, row binary, sums binary, own binary, carried binary")
    schema = docs.select(*(F.col(f"`{c}`") for c in carried)).schema
    result = schema.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double")
    for f in reversed(schema.fields):
        result.fields.insert(0, f)
        result.names.insert(0, f.name)
    n_carried = len(carried)

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        home = next(r for r in rows if r["own"] is not None)
        tokens, among, named_logs, named_known, start = np.frombuffer(home["own"], "<f8").reshape(-1, 5).T
        symbols, logs, known = start.copy(), named_logs.copy(), named_known.copy()
        # always in the same order, so that a rerun adds up alike
        for r in sorted((r for r in rows if r["row"] is not None), key=lambda r: r["row"] + r["sums"]):
            at = np.frombuffer(r["row"], "<u4")
            for to, what in zip((symbols, logs, known), np.frombuffer(r["sums"], "<f8").reshape(3, -1)):
                to[at] += what
        end = np.log10(alphabet.rows + 1.0)
        extra = pa.ipc.open_stream(home["carried"]).read_all() if n_carried else None
        return pa.Table.from_arrays(
            [extra.column(i) for i in range(n_carried)]
            + [
                pa.array(tokens.astype(np.int64), pa.int64()),
                pa.array(known.astype(np.int64) + int(alphabet.rows > 0), pa.int64()),
                pa.array(np.full(len(tokens), n_all), pa.int64()),
                pa.array(logs + end - tokens * np.log10(n_all + 1.0 * (vocabulary + 1)), pa.float64()),
                pa.array(symbols + logs - among, pa.float64()),
            ],
            names=[f.name for f in result.fields],
        )

    return answers.groupBy("block").applyInArrow(finish, result)
