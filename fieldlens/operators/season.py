"""Season analytics over observation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import running


def running_harvest(rows: DataFrame, plant: str, day: str, grams: str) -> DataFrame:
    """rows with the plant's cumulative grams by day and its first day with any; days of a plant must differ for stable sums.

    A plant with most of the rows is many tasks' work.
    """
    first = rows.groupBy(F.col(plant).alias("_plant")).agg(F.min(F.when(F.col(grams) > 0, F.col(day))).alias("first_harvest"))
    out = running(rows, [plant], [F.col(day)], {"cumulative": ("sum", F.col(grams))})
    return out.join(first, F.col(plant).eqNullSafe(F.col("_plant")), "left").drop("_plant")


def _steps(c: Column, bounds: list[float], points: list[int], up: bool = True) -> Column:
    out = None
    for b, p in zip(bounds, points):
        test = c >= b if up else c < b
        out = F.when(test, p) if out is None else out.when(test, p)
    return out.otherwise(points[len(bounds)] if len(points) > len(bounds) else 0)


def season_score(grams: Column, days: Column, peak_disease: Column, flavor: Column, vigour: Column, small_fruit: Column) -> Column:
    """Points out of 100 for yield, speed, health, flavour and vigour; small fruit has lower yield bounds."""
    g = F.when(small_fruit, grams / 0.7).otherwise(grams)
    points = _steps(g, [1500, 1000, 500, 200, 50], [25, 20, 15, 10, 5]) + _steps(days, [60, 70, 80, 90, 100], [25, 20, 15, 10, 5], up=False)
    points = points + F.coalesce(F.try_element_at(F.array(*(F.lit(v) for v in (20, 16, 12, 6, 0))), (peak_disease + 1).cast("int")), F.lit(0))
    return points + _steps(flavor, [9, 7, 5, 3], [15, 12, 8, 4]) + F.least(F.coalesce(vigour, F.lit(0)), F.lit(15))


def tier(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 65, "good").when(score >= 45, "fair").otherwise("poor")


def success(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count_if(F.col("score") >= 65).alias("good"), F.count_if(F.col("score") >= 80).alias("excellent")).withColumn("success", (F.col("good") >= 3) & (F.col("excellent") >= 1))


def weekly_weather(observations: DataFrame, weather: DataFrame, day: str, value: str, factor: str) -> DataFrame:
    """(weeks, correlation) of weekly sums with the weather of the week that starts on Monday."""
    weeks = observations.groupBy(F.to_date(F.date_trunc("week", day)).alias("week_start")).agg(F.sum(value).alias("v"))
    return weeks.join(weather.select("week_start", factor), "week_start").agg(F.count("*").alias("weeks"), F.corr("v", factor).alias("correlation"))


def tasting(sessions: DataFrame) -> DataFrame:
    """sessions: (taster, varieties array<struct(variety, rating, tags array, grow_again)>) to one row a variety."""
    v = sessions.select("taster", F.explode("varieties").alias("v")).select("taster", "v.*")
    return v.groupBy("variety").agg(
        F.count("*").alias("tastings"), F.avg("rating").alias("mean_rating"), F.avg(F.col("grow_again").cast("int")).alias("grow_again_share"), F.avg(F.col("rating").isNotNull().cast("int")).alias("filled_share")
    )


def tag_counts(sessions: DataFrame) -> DataFrame:
    return sessions.select(F.explode("varieties").alias("v")).select("v.variety", F.explode("v.tags").alias("tag")).groupBy("variety", "tag").agg(F.count("*").alias("n"))


def coarse_location(lat: Column, lon: Column) -> Column:
    return F.struct(F.round(lat, 1).alias("latitude"), F.round(lon, 1).alias("longitude"))
