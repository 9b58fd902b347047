"""Days in intervals by equal joins: an interval is cut into aligned blocks of 1, 2, 4, ... days, of which each day has one a level.

A closed interval is at most two blocks a level, and a day meets it in exactly one of them. So intervals are first brought
to one row a block, whatever overlaps, and no day is ever compared with an interval that does not hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of 2**21 days at most: all dates from year 1 to 9999 lie within 2**22 days.
LEVELS = 22


def blocks(first: Column, last: Column) -> Column:
    """The blocks (level, block) of the days from first to last, both included; none if either is null or they cross."""
    low, high = F.unix_date(first), F.unix_date(last) + 1

    def at(level: int) -> list[Column]:
        a, b = -F.shiftright(-low, level), F.shiftright(high, level)
        open_ = a < b
        make = lambda n: F.struct(F.lit(level).alias("level"), n.alias("block"))
        return [F.when(open_ & (a.bitwiseAND(1) == 1), make(a)), F.when(open_ & (b.bitwiseAND(1) == 1), make(b - 1))]

    return F.filter(F.array(*(b for level in range(LEVELS) for b in at(level))), lambda b: b.isNotNull())


def above(day: Column) -> Column:
    """The blocks that hold a day, one a level."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", F.unix_date(day), k).alias("block")))


def first_holding(days: DataFrame, day: str, spans: DataFrame, first: str, last: str, order: list[str], values: list[str]) -> DataFrame:
    """(day, found): for each different day the values of the interval, least by order, that holds it.

    Days in no interval and null days give no row. The order must tell intervals apart for a stable result.
    """
    cut = spans.select(F.explode(blocks(F.col(first), F.col(last))).alias("b"), F.struct(*order).alias("o"), F.struct(*values).alias("v"))
    best = cut.groupBy("b").agg(F.min_by("v", "o").alias("v"), F.min("o").alias("o"))
    asked = days.select(day).dropna().distinct().select(day, F.explode(above(F.col(day))).alias("b"))
    return asked.join(best, "b").groupBy(day).agg(F.min_by("v", "o").alias("found"))


def last_within(spans: DataFrame, keys: list[str], first: str, last: str, days: DataFrame, day: str, out: str) -> DataFrame:
    """(keys, out): the last of the days that each interval holds; intervals without one give no row."""
    latest = days.select(day).dropna().distinct().select(F.col(day).alias("d"), F.explode(above(F.col(day))).alias("b")).groupBy("b").agg(F.max("d").alias("d"))
    cut = spans.select(*keys, F.explode(blocks(F.col(first), F.col(last))).alias("b"))
    return cut.join(latest, "b").groupBy(*keys).agg(F.max("d").alias(out))
