"""Mixing to target weights with soft membership: a classifier learned from a labelled table gives each document
posteriors over domains, and projected-gradient least squares finds document rates >= 0 whose expected domain token
totals match the targets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_SPACE, concat_rows, free_name, runs, scratch, slices, span_hashes
from .quality import _CLASS, CLASSES

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.93, "low": 0.02, "toxic": 0.05}
BITS = 18
DENSE = CLASSES + 3
CHOSEN = 256


def domain_of(labels: DataFrame) -> Column:
    """0 clean, 1 low quality, 2 toxic; null where the labels are."""
    return F.when(F.col("quality") == 0, 1).when(F.col("toxic") == 1, 2).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)


def _describe(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: dense features and tokens; per word: hash bucket and row. Words lose their edge signs."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    signs = np.bincount(row * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    ws, we = runs(NOT_SPACE[data])
    owner = row[ws] if len(ws) else np.zeros(0, np.int64)
    low = LOWER[data]
    count = np.bincount(owner, minlength=n)
    whole = span_hashes(low, ws, we)
    again = np.bincount(owner[1:][(whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(ws) else np.zeros(n)
    letter = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    ls, le = runs(letter)
    bucket = (span_hashes(low, ls, le) >> np.uint64(64 - BITS)).astype(np.int64)
    some = np.maximum(count, 1)
    dense = np.concatenate([signs / np.diff(offsets)[:, None], (again / some)[:, None], np.log1p(count)[:, None], np.log1p(np.diff(offsets) / some)[:, None]], axis=1)
    return dense, count, bucket, row[ls] if len(ls) else np.zeros(0, np.int64)


@dataclass
class DomainModel:
    """Softmax regression over dense features and the presence of chosen word buckets."""

    mean: np.ndarray
    scale: np.ndarray
    place: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, dense: np.ndarray, bucket: np.ndarray, owner: np.ndarray) -> np.ndarray:
        logits = ((dense - self.mean) / self.scale) @ self.weights[:DENSE] + self.bias
        at = self.place[bucket]
        known = at >= 0
        pairs = np.unique(owner[known] * CHOSEN + at[known])
        np.add.at(logits, pairs // CHOSEN, self.weights[DENSE + pairs % CHOSEN])
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, steps: int = 300, text: str = "text", doc_id: str = "doc_id") -> DomainModel:
    """Fits the classifier on at most per_class labelled documents of each domain, taken by the hash of the id.

    An id with several labels has the greatest of their domains. Domains without labelled documents get only the
    prior of one document.
    """
    known = labels.select(F.col(f"`{doc_id}`").alias("_id"), domain_of(labels).alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y"))
    parts = [known.filter(F.col("_y") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for k in range(len(DOMAINS))]
    sizes = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sample = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_text", "_y")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense, words = [], []
            for _, _, data, offsets in slices(batch.column(1)):
                d, _, bucket, owner = _describe(data, offsets)
                dense += [x.astype("<f8").tobytes() for x in d]
                cut = np.searchsorted(owner, np.arange(len(d) + 1))
                words += [np.unique(bucket[a:b]).astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dense, pa.binary()), pa.array(words, pa.binary()), batch.column(2)], names=["_id", "dense", "words", "_y"]
            )

    schema = T.StructType([sample.schema["_id"], *T.StructType.fromDDL("dense binary, words binary, _y int").fields])
    found = sample.mapInArrow(describe, schema).orderBy(F.xxhash64("_id"), "dense").limit(len(DOMAINS) * per_class).collect()
    y = np.array([r["_y"] for r in found], np.int64)
    dense = np.array([np.frombuffer(r["dense"], "<f8") for r in found]).reshape(-1, DENSE)
    words = [np.frombuffer(r["words"], "<i4") for r in found]
    return fit(dense, words, y, np.array([sizes.get(k, 0) for k in range(len(DOMAINS))], np.float64), steps)


def fit(dense: np.ndarray, words: list[np.ndarray], y: np.ndarray, sizes: np.ndarray, steps: int) -> DomainModel:
    k = len(DOMAINS)
    place = np.full(1 << BITS, -1, np.int64)
    mean, scale = (dense.mean(axis=0), dense.std(axis=0) + 1e-3) if len(y) else (np.zeros(DENSE), np.ones(DENSE))
    weights, bias = np.zeros((DENSE + CHOSEN, k)), np.zeros(k)
    if not len(y):
        return DomainModel(mean, scale, place, weights, bias)
    seen = np.stack([np.bincount(np.concatenate([np.zeros(0, np.int64), *(w for w, c in zip(words, y) if c == j)]), minlength=1 << BITS) for j in range(k)])
    docs = np.bincount(y, minlength=k)
    expected = docs[:, None] * (seen.sum(axis=0) / len(y))
    chi = ((seen - expected) ** 2 / np.maximum(expected, 1)).sum(axis=0)
    top = np.argsort(-chi, kind="stable")[:CHOSEN]
    place[top] = np.arange(len(top))
    x = np.zeros((len(y), DENSE + CHOSEN))
    x[:, :DENSE] = (dense - mean) / scale
    for i, w in enumerate(words):
        at = place[w]
        x[i, DENSE + at[at >= 0]] = 1
    one = np.eye(k)[y]
    m = v = mb = vb = 0.0
    for i in range(1, steps + 1):
        logits = x @ weights + bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        miss = (p / p.sum(axis=1, keepdims=True) - one) / len(y)
        g, gb = x.T @ miss + 1e-4 * weights, miss.sum(axis=0)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c, d = 1 - 0.9**i, 1 - 0.999**i
        weights = weights - 0.05 * (m / c) / (np.sqrt(v / d) + 1e-8)
        bias = bias - 0.05 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    # the sample takes its domains in other shares than the labelled table: the prior is put right
    bias = bias + np.log((sizes + 1) / (sizes + 1).sum()) - np.log((docs + 1) / (docs + 1).sum())
    return DomainModel(mean, scale, place, weights, bias)


def posteriors(docs: DataFrame, model: DomainModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens (whitespace-separated words) and p_<domain>. A null text is empty: no token, some posterior."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    new = T.StructType.fromDDL("n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))
    names = {f.name for f in new}
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in names]
    extra = text not in carried
    source = docs.select(*(F.col(f"`{c}`") for c in carried), *([F.col(f"`{text}`")] if extra else []))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [np.zeros(0, np.int64)], [np.zeros((0, len(DOMAINS)))]
            for _, _, data, offsets in slices(batch.column(batch.schema.names.index(text))):
                dense, count, bucket, owner = _describe(data, offsets)
                counts.append(count)
                found.append(sent.value.posteriors(dense, bucket, owner))
            p = np.concatenate(found)
            yield concat_rows(
                batch,
                [text] if extra else [],
                {"n_tokens": pa.array(np.concatenate(counts), pa.int64()), **{f"p_{d}": pa.array(p[:, k], pa.float64()) for k, d in enumerate(DOMAINS)}},
            )

    return source.mapInArrow(judge, T.StructType([source.schema[c] for c in carried] + list(new.fields)))


def rates_of(p: np.ndarray, moves: list[np.ndarray]) -> np.ndarray:
    """The rates after all moves: each takes a step against the posteriors and projects onto rates >= 0."""
    rate = np.ones(len(p))
    for v in moves:
        rate = np.maximum(0.0, rate - p @ v)
    return rate


def _posteriors_in(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(f"p_{d}").to_numpy(zero_copy_only=False) for d in DOMAINS], axis=1).reshape(-1, len(DOMAINS))


def _sums(judged: DataFrame, moves: list[np.ndarray]) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Over all documents: tokens, domain sums at the rates, what the last move changed, and the second moments."""
    k = len(DOMAINS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + k + k * k)
        for batch in batches:
            n, p = batch.column("n_tokens").to_numpy().astype(np.float64), _posteriors_in(batch)
            r, was = rates_of(p, moves), rates_of(p, moves[:-1])
            total += np.concatenate([[n.sum(), (n * (r - was) ** 2).sum()], (r * n) @ p, (p.T @ (n[:, None] * p)).ravel()])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array(total, pa.float64())})

    sums = judged.select("n_tokens", *(f"p_{d}" for d in DOMAINS)).mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    found = np.zeros(2 + k + k * k)
    for r in sums.collect():
        found[r["i"]] = r["v"]
    return found[0], found[2 : 2 + k], found[1], found[2 + k :].reshape(k, k)


def fit_rates(judged: DataFrame, targets: dict[str, float], most_steps: int = 60, tolerance: float = 1e-6) -> tuple[list[np.ndarray], dict[str, float]]:
    """Moves that take the rates from 1 to the least-squares solution, and the expected share of each domain then.

    Minimised is the sum over domains of weight * (rate * tokens * posterior, added up, - target * all tokens)^2, over
    rates >= 0. The weights are the inverse second moments of the domains, so that misses count in proportion to what a
    domain holds. It is projected gradient in the metric of the tokens, which is diagonal: a step changes a document's
    rate by its posteriors times one vector, the weighted misses, and then takes the positive part. The first step's
    length is the inverse of the greatest curvature; later ones take the curvature along the last step, and fall back to
    the first length after a step whose sum is worse than the last five. Where posteriors are nearly sure a few steps do. Each step is
    one aggregate over all documents; the driver sees K + K * K sums. The best rates met are returned, so targets
    beyond reach end near the least sum. A domain without a target keeps its present share, and the named ones
    share the rest in proportion to their targets.
    """
    k = len(DOMAINS)
    moves: list[np.ndarray] = []
    best: tuple[float, list[np.ndarray], np.ndarray] = (np.inf, [], np.zeros(k))
    wanted, weights, safe, last, calm = None, None, 0.0, None, 0
    lately: list[float] = []
    for _ in range(most_steps + 1):
        total, m, moved, g = _sums(judged, moves)
        if total == 0:
            return [], {d: 0.0 for d in DOMAINS}
        if weights is None:
            free = sum(m[i] for i, d in enumerate(DOMAINS) if d not in targets) / total
            named = sum(targets.values()) or 1.0
            wanted = np.array([targets[d] / named * (1 - free) if d in targets else m[i] / total for i, d in enumerate(DOMAINS)]) * total
            weights = 1 / np.maximum(g.diagonal(), 1e-12 * total)
            safe = 1 / np.linalg.eigvalsh(g * np.sqrt(np.outer(weights, weights))).max()
        gap = m - wanted
        miss = float((weights * gap * gap).sum())
        worse = bool(lately) and miss > max(lately[-5:])
        lately.append(miss)
        curved = float((weights * (m - last) ** 2).sum()) if last is not None else 0.0
        step = moved / curved if curved > 0 and not worse else safe
        calm = calm + 1 if miss > (1 - 1e-4) * best[0] else 0
        if miss < best[0]:
            best = (miss, list(moves), m)
        if np.abs(gap).sum() <= tolerance * total or calm > 20:
            break
        last = m
        moves.append(step * weights * gap)
    return best[1], dict(zip(DOMAINS, (best[2] / max(best[2].sum(), 1e-300)).tolist()))


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] = TARGETS,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: list[str] | None = None,
    model: DomainModel | None = None,
) -> DataFrame:
    """docs with n_tokens, p_<domain>, rate and copies.

    copies is the rate rounded down or up by a draw from the hash of id and text, so its expectation is the rate and a
    rerun draws alike; repeated rows draw alike too. Documents without tokens keep the rate of their posteriors. Rates
    have no upper bound: a domain of few documents is repeated as often as its target asks. Null
    ids and texts take part. No rows give no rows. Columns that clash with new ones are replaced.

    Texts are read once: the kept columns are stored with posteriors and draw, which the fit and the result read.
    """
    model = model or train(docs, labels, text=text, doc_id=doc_id)
    drop = {"rate", "copies"}
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in drop]
    draw = free_name(docs, "_draw")
    uniform = (F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)
    judged = scratch(posteriors(docs.withColumn(draw, uniform), model, text, keep=[*carried, draw]), "mix-posteriors")
    moves, _ = fit_rates(judged, targets)
    # an expression, so that texts that are carried do not pass through Python again
    rate = F.lit(1.0)
    for v in moves:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"p_{d}") * float(v[k]) for k, d in enumerate(DOMAINS)), F.lit(0.0)))
    rated = judged.withColumn("rate", rate)
    return rated.withColumn("copies", (F.floor("rate") + (F.col(draw) < F.col("rate") - F.floor("rate")).cast("int")).cast("int")).drop(draw)
