"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import concat_rows, free_name, scratch

ORDERS = (1, 2, 3)
BITS = 16
SLICES = 64
UNKNOWN = "und"
#: Languages that a task counts before it sends them, and tasks whose counts are added up in one group.
HELD_LANGS, TASKS_ADDED = 64, 1024
_MUL = np.uint32(0x9E3779B1)
_LETTER = re.compile(r"[^\W\d_]")


def _has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts (lower-cased, one after another) and the offsets of each text's."""
    low = [" " + t.lower() + "  " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in low], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))) * len(ORDERS)
    out = np.empty((len(code), len(ORDERS)), np.uint32)
    gram = np.zeros(len(code), np.uint32)
    for k in range(max(ORDERS)):
        moved = np.zeros(len(code), np.uint32)
        moved[: len(code) - k] = code[k:] if k else code
        gram = gram * np.uint32(0x01000193) ^ (moved + np.uint32(k + 1)) * np.uint32(0x85EBCA6B)
        if k + 1 in ORDERS:
            mixed = (gram ^ (gram >> np.uint32(15))) * _MUL
            out[:, ORDERS.index(k + 1)] = mixed >> np.uint32(32 - BITS)
    return out.ravel(), offsets


def _runs(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= most):
            size += len(texts[to] or "")
            to += 1
        yield at, [t or "" for t in texts[at:to]]
        at = to


class Model:
    """The log probabilities (feature, language) of some languages, with their priors among all."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, alpha: float, all_docs: float | None = None):
        self.langs = langs
        smooth = np.ascontiguousarray(counts.T, np.float32) + np.float32(alpha)
        self.matrix = np.log(smooth / smooth.sum(axis=0, dtype=np.float64).astype(np.float32)).astype(np.float32)
        self.prior = np.log((docs + 1) / ((docs + 1).sum() if all_docs is None else all_docs))

    def logs(self, texts: list[str | None]) -> np.ndarray:
        """(text, language): log of prior times likelihood. A text's distinct features times their numbers meet the
        matrix a few at a time."""
        out = np.tile(self.prior, (len(texts), 1))
        step = max(1, (1 << 20) // max(1, len(self.langs)))
        for at, part in _runs(texts):
            found, offsets = features(part)
            row = np.repeat(np.arange(len(part), dtype=np.int64), np.diff(offsets))
            pair, many = np.unique(row << BITS | found, return_counts=True)
            row, found = pair >> BITS, pair & ((1 << BITS) - 1)
            for a in range(0, len(pair), step):
                r = row[a : a + step]
                cut = np.flatnonzero(np.diff(r, prepend=-1))
                each = self.matrix[found[a : a + step]] * many[a : a + step, None]
                out[at + r[cut]] += np.add.reduceat(each, cut, axis=0, dtype=np.float64)
        return out

    def best(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Most likely language of each text, its log, and the log of the sum over the languages."""
        logs = self.logs(texts)
        top = logs.max(axis=1)
        return [self.langs[k] for k in logs.argmax(axis=1)], top, top + np.log(np.exp(logs - top[:, None]).sum(axis=1))


class Counts:
    """Counted n-grams of each language in a table, and the languages (sorted) with their documents."""

    def __init__(self, table: DataFrame, langs: list[str], docs: np.ndarray, alpha: float):
        self.table, self.langs, self.docs, self.alpha = table, langs, docs, alpha

    def model(self, first: int, last: int) -> Model:
        """The model of langs[first:last]; its size is that of so many columns."""
        some = self.langs[first:last]
        counts = np.zeros((len(some), 1 << BITS), np.float32)
        place, width = {x: k for k, x in enumerate(some)}, (1 << BITS) // SLICES
        for r in self.table.filter(F.col("lang").isin(some)).select("slice", "lang", "counts").toLocalIterator():
            counts[place[r["lang"]], r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], "<i8")
        return Model(some, counts, self.docs[first:last], self.alpha, float((self.docs + 1).sum()))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", alpha: float = 0.05) -> Counts:
    """Counts the n-grams of every labelled text (text and language not null).

    Tasks count per language in fixed tables of 2**BITS, for at most HELD_LANGS languages at a time, sent on in slices
    that are added up apart from each other, language by language and in two steps. So neither a language with most of the
    rows nor the number of languages or tasks makes a large group: it has at most 8 KB for each of TASKS_ADDED tasks and
    each time that one of them sends the language.
    """
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    width = (1 << BITS) // SLICES
    names, kinds = ["part", "slice", "lang", "docs", "counts"], [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
    schema = "part int, slice int, lang string, docs long, counts binary"

    def sliced(part: int, total: dict[str, np.ndarray], seen: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for s in range(SLICES):
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part] * len(total), pa.int32()),
                    "slice": pa.array([s] * len(total), pa.int32()),
                    "lang": pa.array(list(total), pa.string()),
                    "docs": pa.array([seen[x] for x in total], pa.int64()),
                    "counts": pa.array([v[s * width : (s + 1) * width].astype("<i8").tobytes() for v in total.values()], pa.binary()),
                }
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = (context.partitionId() if context else 0) // TASKS_ADDED
        total: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, some in _runs(texts):
                found, offsets = features(some)
                own = langs[at : at + len(some)]
                order = sorted(range(len(some)), key=lambda i: own[i])
                for name, mine in itertools.groupby(order, key=lambda i: own[i]):
                    mine = list(mine)
                    chosen = np.concatenate([found[offsets[i] : offsets[i + 1]] for i in mine])
                    total[name] = total.get(name, 0) + np.bincount(chosen, minlength=1 << BITS)
                    seen[name] = seen.get(name, 0) + len(mine)
                    if len(total) >= HELD_LANGS:
                        yield from sliced(part, total, seen)
                        total, seen = {}, {}
        if total:
            yield from sliced(part, total, seen)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        *part, at, name = (k.as_py() for k in key)
        total = np.zeros(width, np.int64)
        for body in table.column("counts"):
            total += np.frombuffer(body.as_buffer(), "<i8")
        one = {"part": part[0] if part else 0, "slice": at, "lang": name, "docs": sum(table.column("docs").to_pylist()), "counts": total.astype("<i8").tobytes()}
        return pa.Table.from_pylist([one], schema=pa.schema(list(zip(names, kinds))))

    summed = rows.mapInArrow(count, schema).groupBy("part", "slice", "lang").applyInArrow(add, schema)
    summed = scratch(summed.groupBy("slice", "lang").applyInArrow(add, schema).select("slice", "lang", "docs", "counts"), "language-counts")
    found = sorted((r["lang"], r["docs"]) for r in summed.filter("slice = 0").select("lang", "docs").collect())
    return Counts(summed, [x for x, _ in found], np.array([n for _, n in found], np.float64), alpha)


def identify(docs: DataFrame, counts: Counts, text: str = "text", keep: list[str] | None = None, max_langs: int = 128) -> DataFrame:
    """docs with lang_pred and score, the posterior of the predicted language.

    A null text, one without any letter, and every text under a model that learned nothing are `und` with score 0.
    Whole texts count; ties go to the language that sorts first. `keep` names the columns to carry (all without it);
    those that clash with new ones are replaced.

    The matrix of up to max_langs languages is broadcast (32 MB at most). With more, the texts are scored against one
    such matrix after the other, and the best language and the sum over all are put together for each row.
    """
    new = T.StructType.fromDDL("lang_pred string, score double")
    carried = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("lang_pred", "score")]
    extra = text not in carried
    source = docs.select(*(F.col(f"`{c}`") for c in carried), *([F.col(f"`{text}`")] if extra else []))
    spans = [(a, min(a + max_langs, len(counts.langs))) for a in range(0, len(counts.langs), max_langs)] or [(0, 0)]

    def scored(rows: DataFrame, span: tuple[int, int], drop: list[str], ddl: str, make) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(counts.model(*span))

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for batch in batches:
                texts = batch.column(batch.schema.names.index(text)).to_pylist()
                known = [bool(m.langs) and _has_letter(t) for t in texts]
                found = m.best([t for t, k in zip(texts, known) if k]) if any(known) else ([], [], [])
                both = iter(zip(*found))
                yield concat_rows(batch, drop, make([next(both) if k else None for k in known]))

        kept = [f for f in rows.schema if f.name not in drop]
        return rows.mapInArrow(predict, T.StructType(kept + list(T.StructType.fromDDL(ddl).fields)))

    if len(spans) == 1:

        def final(out: list) -> dict[str, pa.Array]:
            return {"lang_pred": pa.array([o[0] if o else UNKNOWN for o in out], pa.string()), "score": pa.array([float(np.exp(o[1] - o[2])) if o else 0.0 for o in out], pa.float64())}

        return scored(source, spans[0], [text] if extra else [], "lang_pred string, score double", final)

    uid = free_name(docs, "_uid")
    source = scratch(source.withColumn(uid, F.monotonically_increasing_id()), "language-rows")

    def partial(out: list) -> dict[str, pa.Array]:
        return {"l": pa.array([o[0] if o else None for o in out], pa.string()), "t": pa.array([float(o[1]) if o else None for o in out], pa.float64()), "w": pa.array([float(o[2]) if o else None for o in out], pa.float64())}

    parts = [scratch(scored(source.select(uid, F.col(f"`{text}`")), s, [text], "l string, t double, w double", partial), "language-part") for s in spans]
    every = functools.reduce(DataFrame.unionByName, parts).filter("t IS NOT NULL")
    # logs are put together around their greatest; of languages with equal logs the first block's is the one that sorts first
    top = every.groupBy(uid).agg(F.max("t").alias("_top"), F.min_by("l", F.struct(-F.col("t"), "l")).alias("_lang"), F.collect_list("w").alias("_w"))
    top = top.select(F.col(uid), "_lang", F.expr("1 / aggregate(_w, 0D, (s, w) -> s + exp(w - _top))").alias("_score"))
    out = source.join(top, uid, "left")
    return out.select(*(F.col(f"`{c}`") for c in carried), F.coalesce("_lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("_score", F.lit(0.0)).alias("score"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's text modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts
