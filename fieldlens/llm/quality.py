"""Quality classifier by attention-based multiple-instance learning: a document is a bag of passages, every passage is
encoded, gated attention weighs the encodings, and the weighted sum is scored. Only document labels teach it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, concat_rows, discard, runs, scratch, slices, span_hashes
from .langid import fold

PASSAGE_BYTES = 400
#: Passages that are encoded at once, and that the labelled sample of the fit may have in all (about 100 MB).
BLOCK_PASSAGES, FIT_PASSAGES = 1024, 200_000
_CLASS = np.full(256, 9, np.int64)
for _k, _signs in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", "|", "%&*$#@^~<>{}[]\\=+_", "!", ".,;:?")):
    _CLASS[list(_signs.encode())] = _k
_CLASS[0x80:] = 10
CLASSES = 11
_PLAIN = (_CLASS == 0) | (_CLASS == 1) | (_CLASS == 2) | (_CLASS == 10)
#: Signed buckets of hashed words.
HASHED = 48
SHAPES = CLASSES + 7
FEATURES = SHAPES + HASHED


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all passages, of PASSAGE_BYTES whatever the text's length, and the first passage of each row."""
    many = np.maximum(1, -(-(np.diff(offsets) - 1) // PASSAGE_BYTES))
    first = np.concatenate(([0], np.cumsum(many)))
    row = np.repeat(np.arange(len(many)), many)
    return offsets[row] + (np.arange(first[-1]) - first[row]) * PASSAGE_BYTES, first


def encode(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, stop: int, inside: bool) -> np.ndarray:
    """Features of each passage: shares of sign classes, how long, how varied and how repetitive its words are, and the
    words themselves (without edge signs) in hashed buckets.

    lengths: of the passages' texts. The last passage ends at stop; what follows is the rest of its last word. inside:
    data starts within a word of an earlier passage.
    """
    n = len(starts)
    ends = np.append(starts[1:], stop)
    owner = np.repeat(np.arange(n), ends - starts)
    signs = np.bincount(owner * CLASSES + _CLASS[data[:stop]], minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    size = np.maximum(signs.sum(axis=1), 1)
    ws, we = runs(NOT_SPACE[data])
    own = slice(int(inside), int(np.searchsorted(ws, stop)))
    ws, we = ws[own], we[own]
    low = LOWER[data]
    words = span_hashes(low, ws, we)
    mine = owner[ws] if len(ws) else np.zeros(0, np.int64)
    count = np.bincount(mine, minlength=n)
    some = np.maximum(count, 1)
    again = (words[1:] == words[:-1]) & (mine[1:] == mine[:-1]) if len(ws) else np.zeros(0, bool)
    repeats = np.bincount(mine[1:][again], minlength=n)
    distinct = np.bincount(_owners(words, mine), minlength=n)
    letters = np.bincount(mine, weights=(we - ws), minlength=n)
    symbol = _CLASS[data]
    last = symbol[we - 1] if len(ws) else np.zeros(0, np.int64)
    marked = np.bincount(mine[(last == 6) | (last == 7)], minlength=n)
    capital = np.bincount(mine[symbol[ws] == 1], minlength=n) if len(ws) else np.zeros(n)
    out = np.empty((n, FEATURES))
    out[:, :CLASSES] = signs / size[:, None]
    out[:, CLASSES:SHAPES] = np.stack(
        [repeats / some, distinct / some, np.log1p(letters / some), marked / some, capital / some, np.log1p(count), np.log1p(lengths)], axis=1
    )
    plain = span_hashes(low, *_inner(low, ws, we)) if len(ws) else words
    at = mine * HASHED + (plain >> np.uint64(40)).astype(np.int64) % HASHED
    sign = np.where(plain & np.uint64(1), 1.0, -1.0)
    out[:, SHAPES:] = np.bincount(at, weights=sign, minlength=n * HASHED).reshape(n, HASHED) / np.sqrt(some)[:, None]
    return out.astype(np.float32)


def _inner(low: np.ndarray, ws: np.ndarray, we: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without one sign at either edge, where that leaves something."""
    solid = _PLAIN[low]
    begin, end = ws + ~solid[ws], we - ~solid[we - 1]
    kept = begin < end
    return np.where(kept, begin, ws), np.where(kept, end, we)


def _owners(words: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Passage of each distinct (passage, word)."""
    mixed = words ^ (mine.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(mixed, return_index=True)
    return mine[at]


@dataclass
class Net:
    """W, b encode a passage; V, U and w are the gated attention; c, c0 score the weighted encoding."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        e = np.tanh(x @ p["W"] + p["b"])
        t = np.tanh(e @ p["V"])
        g = 1 / (1 + np.exp(-(e @ p["U"])))
        s = (t * g) @ p["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        s = np.exp(s - np.maximum.reduceat(s, first[:-1])[bag])
        a = s / np.add.reduceat(s, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * e, first[:-1], axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["c0"], -40, 40)))
        return {"e": e, "t": t, "g": g, "a": a, "z": z, "y": y, "bag": bag}

    def score(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
        """Scores of rows whose passages come in blocks (features, row of each): attention is a running weighted sum,
        rescaled when a block has a larger logit."""
        p = self.weights
        top, total, z = np.full(rows, -np.inf), np.zeros(rows), np.zeros((rows, len(p["c"])))
        for x, row in blocks:
            e = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
            s = (np.tanh(e @ p["V"]) / (1 + np.exp(-(e @ p["U"])))) @ p["w"]
            cut = np.flatnonzero(np.diff(row, prepend=-1))
            r = row[cut]
            new = np.maximum(top[r], np.maximum.reduceat(s, cut))
            less = np.exp(top[r] - new)
            s = np.exp(s - np.repeat(new, np.diff(np.append(cut, len(row)))))
            total[r] = total[r] * less + np.add.reduceat(s, cut)
            z[r] = z[r] * less[:, None] + np.add.reduceat(s[:, None] * e, cut, axis=0)
            top[r] = new
        return 1 / (1 + np.exp(-np.clip(z / total[:, None] @ p["c"] + p["c0"], -40, 40)))

    def gradient(self, x: np.ndarray, first: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, first)
        bag = f["bag"]
        miss = (f["y"] - label) / len(label)
        dz = miss[:, None] * p["c"]
        de = f["a"][:, None] * dz[bag]
        da = (f["e"] * dz[bag]).sum(axis=1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, first[:-1])[bag])
        dh = ds[:, None] * p["w"]
        dt = dh * f["g"] * (1 - f["t"] ** 2)
        dg = dh * f["t"] * f["g"] * (1 - f["g"])
        de += dt @ p["V"].T + dg @ p["U"].T
        dx = de * (1 - f["e"] ** 2)
        return {
            "W": x.T @ dx, "b": dx.sum(axis=0), "V": f["e"].T @ dt, "U": f["e"].T @ dg, "w": (f["t"] * f["g"]).T @ ds,
            "c": f["z"].T @ miss, "c0": miss.sum(),
        }


def fit(bags: list[np.ndarray], labels: np.ndarray, width: int = 16, gates: int = 8, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Net:
    """Adam on the log loss of the documents' labels. With labels of one kind, or none, the score is a constant."""
    rng = np.random.default_rng(0)
    x = np.concatenate(bags) if bags else np.zeros((1, FEATURES))
    first = np.concatenate(([0], np.cumsum([len(b) for b in bags] or [1])))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    make = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"W": make(FEATURES, width), "b": np.zeros(width), "V": make(width, gates), "U": make(width, gates), "w": make(gates), "c": make(width), "c0": np.zeros(())}
    net = Net(mean, scale, p)
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not len(labels):
        p["c"] = np.zeros(width)
        p["c0"] = np.array(np.log((share + 0.01) / (1.01 - share)))
        return net
    x = (x - mean) / scale
    m, v = {k: 0.0 for k in p}, {k: 0.0 for k in p}
    for i in range(1, steps + 1):
        for k, g in net.gradient(x, first, labels).items():
            g = g + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    return net


def _blocks(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the passages and the row of each, a block of passages at a time."""
    length = np.diff(offsets)
    for a in range(0, len(starts), BLOCK_PASSAGES):
        b = min(a + BLOCK_PASSAGES, len(starts))
        row = np.searchsorted(first, np.arange(a, b), side="right") - 1
        begin, stop = int(starts[a]), int(starts[b]) if b < len(starts) else len(data)
        solid = NOT_SPACE[data[begin:stop]]
        inside = bool(begin and NOT_SPACE[data[begin - 1]] and solid[0])
        end = stop
        # the last word is read to its end, unless an earlier block has it
        if solid[-1] and not (inside and solid.all()):
            while end < len(data) and (more := NOT_SPACE[data[end : end + PASSAGE_BYTES]]).all():
                end += len(more)
            end += int(np.argmin(more)) if end < len(data) else 0
        yield encode(data[begin:end], starts[a:b] - begin, length[row], stop - begin, inside), row


def _fit_bags(column: pa.Array) -> Iterator[bytes]:
    """Features of all passages of each text."""
    for _, _, data, offsets in slices(column):
        starts, first = passages(data, offsets)
        x = np.concatenate([block for block, _ in _blocks(data, offsets, starts, first)])
        yield from (x[a:b].tobytes() for a, b in zip(first[:-1], first[1:]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, folds: int, text: str, doc_id: str) -> DataFrame:
    """(doc_id, text, label): at most per_class labelled documents of either label, taken by the hash of the id.

    Only ids whose crc32 modulo folds is not 0 take part; null ids and labels do not. An id with several labels has
    their majority, 1 at a tie. The bounded list of ids is broadcast.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("double").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    known = known.filter(fold(F.col("_id"), folds) != 0).groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    rank = F.xxhash64("_id")
    part = lambda y: known.filter(F.col("_y") == y).orderBy(rank, "_id").limit(per_class)
    chosen = part(0).unionByName(part(1))
    source = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    return source.join(F.broadcast(chosen), "_id")


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, folds: int = 5, text: str = "text", doc_id: str = "doc_id", most: int = FIT_PASSAGES
) -> Net:
    """Fits the net on a bounded sample of at most 2 * per_class labelled documents with at most `most` passages in all.

    Spark's tasks encode all passages of each. Should the documents have more passages than `most`, the sample has only
    those below a length with which they have not.
    """
    sample = labelled_sample(docs, labels, label, per_class, folds, text, doc_id)
    sample = sample.filter(F.coalesce(F.octet_length("_text"), F.lit(0)) <= most * PASSAGE_BYTES)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_fit_bags(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], names=["_id", "bag", "_y"])

    schema = T.StructType([sample.schema["_id"], T.StructField("bag", T.BinaryType()), T.StructField("_y", T.IntegerType())])
    bags = sample.select("_id", "_text", "_y").mapInArrow(bag, schema).orderBy(F.xxhash64("_id"), "bag").limit(2 * per_class)
    encoded = scratch(bags, "quality-bags").withColumn("n", F.octet_length("bag") / (4 * FEATURES))
    total, below = 0, 0
    for r in encoded.groupBy("n").agg(F.sum("n").alias("passages")).orderBy("n").collect():
        total += r["passages"]
        if total > most:
            break
        below = r["n"]
    found = encoded.filter(F.col("n") <= below).orderBy(F.xxhash64("_id"), "bag").collect()
    discard(encoded)
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES).astype(np.float64) for r in found]
    return fit(bags, np.array([r["_y"] for r in found], np.float64))


def score_quality(docs: DataFrame, net: Net, threshold: float = 0.3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0).

    The whole text is read; null counts as empty, and an empty text is one empty passage with a score like any other.
    Equal texts score alike. `keep` names the columns to carry (all without it); those that clash with new ones are
    replaced. No rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    new = T.StructType.fromDDL("score double, predicted int")
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("score", "predicted")]
    extra = text not in carried
    source = docs.select(*(F.col(f"`{c}`") for c in carried), *([F.col(f"`{text}`")] if extra else []))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.names.index(text))
            cut = ((data, offsets, *passages(data, offsets)) for _, _, data, offsets in slices(column))
            y = np.concatenate([sent.value.score(_blocks(*c), len(c[1]) - 1) for c in cut])
            yield concat_rows(
                batch, [text] if extra else [], {"score": pa.array(y, pa.float64()), "predicted": pa.array((y >= threshold).astype(np.int32), pa.int32())}
            )

    return source.mapInArrow(score, T.StructType([source.schema[c] for c in carried] + list(new.fields)))
