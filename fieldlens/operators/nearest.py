"""Exact k nearest templates without comparing every target with every template.

Templates gather round pivots, and each pivot's templates are cut, in order of their cosine to it, into pieces of a bounded
number. On the unit sphere angles obey the triangle inequality, so a target's angle to the pivot bounds its cosine to all
of a piece. A target first meets the piece that promises most; its k-th best score there tells which other pieces may hold
anything as good, and only those are met. Nothing is left out: what is skipped cannot reach the k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..sources.shared import stored
from .rank import positions
from .similarity import dot, unit

#: Room for rounded scores (nine digits) and for sines of small angles.
SLACK = 1e-7
#: The piece of targets without a direction: all their scores are equal, so the k first subjects are their answer.
NO_DIRECTION = -1
#: Pieces of a span, and targets of a block: a meeting holds so many of both.
SPAN, BLOCK = 8, 4096


def vectors(lists) -> np.ndarray:
    """The rows of a column of vectors of one width."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def exact_dots(u: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of rows i of u with rows j of t, added from the first term to the last as `similarity.dot` does."""
    out = np.zeros(len(i))
    for c in range(u.shape[1]):
        out += u[i, c] * t[j, c]
    return out


def first_of(row: np.ndarray, score: np.ndarray, subjects: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, negated score, subject) of the k greatest scores of each row, in order; ties by subject."""
    table = pa.table({"row": pa.array(row), "n": pa.array(score), "s": subjects})
    table = table.take(pc.sort_indices(table, sort_keys=[("row", "ascending"), ("n", "ascending"), ("s", "ascending")])).combine_chunks()
    row = table.column("row").to_numpy()
    kept = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) < k)
    table = table.take(pa.array(kept)).combine_chunks()
    return table.column("row").to_numpy(), table.column("n").to_numpy(), pa.concat_arrays(table.column("s").chunks) if len(kept) else subjects[:0]


def nine_digits(score: np.ndarray) -> np.ndarray:
    """Scores rounded as Spark rounds them."""
    values, back = np.unique(score, return_inverse=True)
    nine = Decimal("1e-9")
    return np.array([float(Decimal(repr(v)).quantize(nine, ROUND_HALF_UP)) for v in values.tolist()], float)[back]


def _best(k: int) -> Column:
    """The k first (negated score, subject) of the templates `_all` for the target `_u`."""
    return F.slice(F.array_sort(F.transform("_all", lambda r: F.struct((-F.round(dot(F.col("_u"), r["t"]), 9)).alias("n"), r["s"].alias("s")))), 1, k)


def _deal(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The templates (s, t) with the number p of the pivot that each is nearest to, or -1, and its cosine d."""
        for batch in batches:
            t = vectors(batch.column("t"))
            cosines = t @ pivots.T if len(pivots) and len(t) else np.full((len(t), 1), -np.inf)
            some = (t * t).sum(axis=1) > 0.5
            p, d = np.where(some, cosines.argmax(axis=1), -1), np.where(some, cosines.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.int32()), pa.array(d, pa.float64())], names=["s", "t", "p", "d"])

    return run


def pieces_of(known: DataFrame, subject: str, pivots: int, piece: int) -> tuple[DataFrame, DataFrame]:
    """(piece, span, all) and (piece, span, pivot, low, high, many): stored pieces of the templates and the cosines to their pivots.

    Pivots are the templates whose subjects' hashes are least. Templates without a direction lie round a pivot of their own,
    the zero vector: their cosine to anything is 0. A span is SPAN pieces that follow each other round a pivot.
    """
    t = known.select(F.col(subject).alias("s"), F.col("template").alias("t"))
    chosen = t.filter(dot(F.col("t"), F.col("t")) > 0.5).orderBy(F.xxhash64("s"), "s").limit(pivots)
    vectors_of = [r["t"] for r in chosen.select("t").collect()]
    shape = T.StructType([*t.schema.fields, T.StructField("p", T.IntegerType()), T.StructField("d", T.DoubleType())])
    dealt = positions(t.mapInArrow(_deal(np.array(vectors_of)), shape), ["p"], [-F.col("d"), F.col("s")], "at")
    dealt = dealt.withColumn("nth", F.floor((F.col("at") - 1) / piece))
    held = dealt.groupBy("p", "nth").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.collect_list(F.struct("s", "t")).alias("all"))
    hashed = lambda *c: F.xxhash64(*c).bitwiseAND((1 << 62) - 1)
    held = stored(held.select(hashed("p", "nth").alias("piece"), hashed("p", F.floor(F.col("nth") / SPAN)).alias("span"), "p", "low", "high", "all"), "template-pieces")
    numbered = known.sparkSession.createDataFrame([(i, v) for i, v in enumerate(vectors_of)], "p int, pivot array<double>")
    bounds = held.select("piece", "span", "p", "low", "high", F.size("all").alias("many")).join(F.broadcast(numbered), "p", "left").drop("p")
    return held.select("piece", "span", "all"), bounds


def reach(cosine: Column, low: Column, high: Column) -> Column:
    """Upper bound of the cosine to templates whose cosines to the pivot are within [low, high], of a target's to it."""
    sine = lambda c: F.sqrt(F.greatest(1 - c * c, F.lit(0.0)))
    apart = lambda c: cosine * c + sine(cosine) * sine(c)
    return F.when(cosine < low, apart(low)).when(cosine > high, apart(high)).otherwise(F.lit(1.0))


def asked(targets: DataFrame, vector: str, key: str, pieces: DataFrame, bounds: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, u, least, span, pieces) for the pieces that targets meet after their first, and (id, key, piece, best) of
    the first meeting, of which best may have fewer than k.

    The bounds of all pieces are broadcast: a vector for each pivot, and 32 bytes a piece.
    """
    spans = bounds.groupBy("span", F.coalesce("pivot", F.array().cast("array<double>")).alias("pivot")).agg(F.collect_list(F.struct("piece", "low", "high", "many")).alias("of"))
    grouped = spans.groupBy("pivot").agg(F.collect_list(F.struct("span", "of")).alias("spans"))
    index = F.broadcast(grouped.agg(F.collect_list(F.struct("pivot", "spans")).alias("_index")))

    def reached(pivot: Column) -> Column:
        has = F.size(pivot["pivot"]) > 0
        most = lambda c, p: F.when(has, reach(c, p["low"], p["high"])).otherwise(F.lit(0.0))
        of = lambda c, s: F.transform(s["of"], lambda p: F.struct((p["many"] >= k).alias("full"), most(c, p).alias("most"), p["piece"].alias("piece"), s["span"].alias("span")))
        own = lambda c: F.transform(pivot["spans"], lambda s: F.struct(s["span"].alias("span"), of(c, s).alias("of")))
        return F.element_at(F.transform(F.array(dot(F.col("_u"), pivot["pivot"])), own), 1)

    promised = F.flatten(F.transform("_index", reached))
    each = targets.select(F.col(key).alias("_key"), unit(F.col(vector)).alias("_u")).withColumn("_id", F.monotonically_increasing_id())
    each = stored(each, "match-targets")
    directed = F.coalesce(dot(F.col("_u"), F.col("_u")) > 0.5, F.lit(False))
    placed = stored(each.filter(directed).join(index, F.lit(True)).select("_id", "_key", "_u", F.array_max(F.flatten(F.transform(promised, lambda s: s["of"]))).alias("_first")).filter("_first IS NOT NULL"), "match-placed")
    begin = placed.select("_id", "_key", "_u", F.lit(-2.0).alias("_least"), F.col("_first.span").alias("span"), F.array("_first.piece").alias("pieces"))
    best = stored(meetings(begin, pieces, k), "match-first")
    lone = pieces.filter(F.col("piece") == NO_DIRECTION).select(F.col("all").alias("_all"))
    first = placed.select("_id", F.col("_first.piece").alias("piece")).join(best, "_id")
    first = first.unionByName(each.filter(~directed).join(F.broadcast(lone), F.lit(True)).select("_id", F.lit(NO_DIRECTION).cast("bigint").alias("piece"), "_key", _best(k).alias("_best")))
    # a full first meeting gives the k-th best score to beat; after another, everything may count
    least = F.when(F.size("_best") >= k, -F.element_at("_best", -1)["n"]).otherwise(F.lit(-2.0))
    open_ = placed.join(best.select("_id", least.alias("_least")), "_id").join(index, F.lit(True))
    good = lambda r: (r["most"] >= F.col("_least") - SLACK) & (r["piece"] != F.col("_first.piece"))
    more = F.transform(promised, lambda s: F.struct(s["span"].alias("span"), F.transform(F.filter(s["of"], good), lambda r: r["piece"]).alias("pieces")))
    more = F.filter(more, lambda s: F.size(s["pieces"]) > 0)
    return open_.select("_id", "_key", "_u", "_least", F.explode(more).alias("m")).select("_id", "_key", "_u", "_least", "m.span", "m.pieces"), first


def _meet(k: int, shape: pa.Schema):
    def run(targets: pa.Table, pieces: pa.Table) -> pa.Table:
        """(_id, _key, _best): the k best of each target among those pieces of one span that it asks for."""
        targets, pieces = targets.combine_chunks(), pieces.combine_chunks()
        u, least = vectors(targets.column("_u")), targets.column("_least").to_numpy()
        asks = targets.column("pieces").combine_chunks()
        lists, asked_by = asks.flatten().to_numpy(), np.repeat(np.arange(len(u)), pc.list_value_length(asks).to_numpy())
        least, found = least.copy(), []
        for number, held in zip(pieces.column("piece").to_pylist(), pieces.column("all").combine_chunks()):
            who = np.sort(asked_by[lists == number])
            if not len(who):
                continue
            t, subjects = vectors(held.values.field("t")), held.values.field("s")
            rough = u[who] @ t.T
            # what may be among the k best, whatever the order in which products are added
            good = rough >= least[who][:, None] - SLACK
            many = np.flatnonzero(good.sum(axis=1) > k)
            if len(many):
                kth = np.partition(rough[many], -k, axis=1)[:, -k]
                least[who[many]] = np.maximum(least[who[many]], kth)
                good[many] &= rough[many] >= kth[:, None] - SLACK
            i, j = np.nonzero(good)
            found.append(first_of(who[i], -nine_digits(exact_dots(u, t, who[i], j)), subjects.take(pa.array(j)), k))
        row, n, subjects = (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), pa.concat_arrays([f[2] for f in found]))
        row, n, subjects = first_of(row, n, subjects, k)
        some, counts = np.unique(row, return_counts=True)
        kind = shape.field("_best").type
        best = pa.StructArray.from_arrays([pa.array(n, pa.float64()), subjects], fields=list(kind.value_type))
        best = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), best)
        return pa.Table.from_arrays([*(targets.column(c).take(pa.array(some)) for c in ("_id", "_key")), best.cast(kind)], schema=shape)

    return run


def meetings(asks: DataFrame, pieces: DataFrame, k: int) -> DataFrame:
    """(_id, _key, _best): for each row of asks (_id, _key, _u, _least, span, pieces), the k first (negated score, subject) of
    the templates in those pieces of that span; scores below _least need not be there.

    A meeting is a span and a block of about BLOCK targets: neither a hot piece nor many targets make a large group.
    """
    asks = stored(asks, "match-asks")
    blocks = max(1, -(-asks.groupBy("span").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] // BLOCK)) if asks.limit(1).count() else 1
    asks = asks.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(blocks)))
    needed = asks.select(F.col("span").alias("in_span"), F.col("block").alias("in_block"), F.explode("pieces").alias("piece")).distinct()
    brought = pieces.select("piece", "all").join(needed, "piece")
    subject = pieces.schema["all"].dataType.elementType["s"].dataType
    best = T.ArrayType(T.StructType([T.StructField("n", T.DoubleType()), T.StructField("s", subject)]))
    shape = T.StructType([T.StructField("_id", T.LongType()), asks.schema["_key"], T.StructField("_best", best)])
    return asks.groupBy("span", "block").cogroup(brought.groupBy("in_span", "in_block")).applyInArrow(_meet(k, to_arrow_schema(shape)), shape)


def _all_pieces(known: DataFrame, subject: str, k: int, pivots: int, piece: int) -> tuple[DataFrame, DataFrame]:
    known = stored(known.select(subject, "template").dropna(subset=["template"]), "templates")
    pieces, bounds = pieces_of(known, subject, pivots, piece)
    lone = known.select(F.struct(F.col(subject).alias("s"), F.col("template").alias("t")).alias("r")).orderBy("r.s").limit(k).agg(F.collect_list("r").alias("all"))
    lone = lone.filter(F.size("all") > 0).select(F.lit(NO_DIRECTION).cast("bigint").alias("piece"), F.lit(NO_DIRECTION).cast("bigint").alias("span"), "all")
    return pieces.unionByName(lone), bounds


def nearest(targets: DataFrame, vector: str, known: DataFrame, subject: str, key: str, k: int = 3, pivots: int = 64, piece: int = 1024) -> DataFrame:
    """(key, subject, score, rank): as `similarity.matches`, for any number of templates, each of length one or zero.

    Each target row gets its k best, ties by subject; repeated keys are rows of their own; targets of length zero or null
    get the k first subjects. No templates or no targets give no rows. A piece is one row of `piece` templates. Blocks of
    targets meet spans of pieces as products of matrices; what may count is scored again term by term, as Spark adds it.
    """
    pieces, bounds = _all_pieces(known, subject, k, pivots, piece)
    more, first = asked(targets, vector, key, pieces, bounds, k)
    met = meetings(more, pieces, k).select("_id", "_key", "_best").unionByName(first.drop("piece"))
    # Spark keeps k rows of each target in every task before it shuffles them
    order = Window.partitionBy("_id").orderBy("b.n", "b.s")
    best = met.select("_id", "_key", F.explode("_best").alias("b")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.col("_key").alias(key), F.col("b.s").alias(subject), (-F.col("b.n")).alias("score"), "rank")


def pruning(targets: DataFrame, vector: str, known: DataFrame, subject: str, key: str, k: int = 3, pivots: int = 64, piece: int = 1024) -> DataFrame:
    """One row (targets, templates, pairs, met): all pairs there are, and those that `nearest` compares beside the pivots."""
    pieces, bounds = _all_pieces(known, subject, k, pivots, piece)
    more, first = asked(targets, vector, key, pieces, bounds, k)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    met = more.select(F.explode("pieces").alias("piece")).unionByName(first.select("piece")).join(bounds, "piece").agg(total("many").alias("met"))
    n, m = bounds.agg(total("many").alias("templates")), first.agg(F.count("*").alias("targets"))
    return n.join(m, F.lit(True)).join(met, F.lit(True)).select("targets", "templates", (F.col("targets") * F.col("templates")).alias("pairs"), "met")
