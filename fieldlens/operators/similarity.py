"""Vector templates, cosine matches and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    # the norm is an array of one, so that it is not worked out again for each element
    each = lambda norm: F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), each), 1)


def templates(vectors: DataFrame, subject: str, vector: str) -> DataFrame:
    """(subject, template): mean of the subject's vectors, of length one."""
    each = vectors.select(subject, F.posexplode(vector).alias("pos", "x")).groupBy(subject, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return each.groupBy(subject).agg(mean.alias("mean")).select(subject, unit(F.col("mean")).alias("template"))


def matches(targets: DataFrame, vector: str, known: DataFrame, subject: str, key: str, k: int = 3, most_templates: int = 10_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(key, subject, score, rank): the k templates nearest to each target, ties by subject.

    Up to most_templates of at most most_bytes together are broadcast and every target is compared with all; of more, each
    target meets only those that bounds of angles do not rule out (`nearest.nearest`), with the same rows.
    """
    from .nearest import nearest

    n, width = known.agg(F.count("*"), F.coalesce(F.sum(F.size("template").cast("bigint") * 8), F.lit(0))).first()
    if n > most_templates or width > most_bytes:
        return nearest(targets, vector, known, subject, key, k)
    block = F.struct(F.col(subject).alias("s"), F.col("template").alias("t"))
    best = F.slice(F.array_sort(F.transform("_all", lambda r: F.struct((-F.round(dot(F.col("_u"), r["t"]), 9)).alias("n"), r["s"].alias("s")))), 1, k)
    each = targets.select(key, unit(F.col(vector)).alias("_u"))
    found = each.join(F.broadcast(known.agg(F.collect_list(block).alias("_all"))), F.lit(True)).select(key, best.alias("_best"))
    return found.select(key, F.posexplode("_best").alias("p", "b")).select(key, F.col("b.s").alias(subject), (-F.col("b.n")).alias("score"), (F.col("p") + 1).alias("rank"))


def accuracy(found: DataFrame, truth: DataFrame, key: str, subject: str) -> DataFrame:
    """(rows, top1, top3) with four digits."""
    per = found.join(truth.select(key, F.col(subject).alias("_t")), key).groupBy(key).agg(
        F.max(((F.col("rank") == 1) & (F.col(subject) == F.col("_t"))).cast("int")).alias("a"), F.max((F.col(subject) == F.col("_t")).cast("int")).alias("b")
    )
    return per.agg(F.count("*").alias("rows"), F.round(F.avg("a"), 4).alias("top1"), F.round(F.avg("b"), 4).alias("top3"))


def votes(tries: DataFrame) -> DataFrame:
    """(row_key, number, votes): variants that show the number. tries: (row_key, variant, numbers).

    Few tries repeat, so they are dealt before repeats are sought: a reading task would gather all rows of its split.
    """
    each = tries.select("row_key", "variant", F.explode(F.array_distinct("numbers")).alias("number")).repartition("row_key", "number").distinct()
    return each.groupBy("row_key", "number").agg(F.count("*").alias("votes"))


def decisions(rows: DataFrame, voted: DataFrame) -> DataFrame:
    """(row_key, number, votes, tier). rows: (row_key, visual_top1 number or null)."""
    order = Window.partitionBy("row_key").orderBy(F.desc("votes"), "number")
    top = voted.withColumns({"_r": F.row_number().over(order), "_ties": F.count("*").over(Window.partitionBy("row_key", "votes"))}).filter("_r = 1")
    j = rows.join(top, "row_key", "left")
    high = (F.col("votes") >= 5) & (F.col("_ties") == 1)
    medium = (F.col("votes") >= 4) & (F.col("_ties") == 1) & (F.col("visual_top1") == F.col("number"))
    tier = F.when(high, "ocr_high").when(medium, "ocr_visual_medium").otherwise("needs_manual")
    return j.select(
        "row_key", F.coalesce("number", "visual_top1", F.lit(0)).alias("number"), F.when(high | medium, F.col("votes")).otherwise(F.lit(0)).alias("votes"), tier.alias("tier")
    )


def hard_rows(rows: DataFrame, mapped: DataFrame, vector: str, known: DataFrame, subject: str, voted: DataFrame, most: int) -> DataFrame:
    """Rows that no mapping has, with the number that pictures and votes suggest.

    rows: (row_key, vector); mapped: (row_key); known: numbered templates; voted: (row_key, number, votes). The margin
    is between the two nearest templates (0 stands for a second that is not there). Numbers outside 1..most fall away.
    """
    left = rows.join(mapped.select("row_key").distinct(), "row_key", "left_anti")
    near = matches(left, vector, known, subject, "row_key", k=3)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    seen = near.groupBy("row_key").agg(at(1, subject).alias("visual_top1"), (at(1, "score") - F.coalesce(at(2, "score"), F.lit(0.0))).alias("margin"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", subject))), lambda s: s[subject].cast("string")), ",").alias("top3"))
    said = decisions(seen.select("row_key", "visual_top1"), voted)
    return seen.join(said, "row_key").filter(F.col("number").between(1, most))
