"""Scores and decision rules over metric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def growth(now: Column, base: Column) -> Column:
    return F.when(base > 0, (now - base) / base)


def health_v1(cov: Column, g: Column, chl: Column, n: Column, brightness: Column, blur: Column) -> Column:
    q = F.when((brightness < 45) | (brightness > 225), 0.6).otherwise(1.0) * F.when(blur < 120, 0.7).otherwise(1.0)
    grown = F.when(g.isNull(), 0.55).otherwise(clip(g + 0.25))
    total = 45 * F.least(cov / 0.10, F.lit(1.0)) + 20 * grown + 20 * (1 - F.least(chl / 0.45, F.lit(1.0)))
    total = total + 10 * F.greatest(F.lit(0.0), 1 - F.abs(n - 2) / 3) + 5 * q
    return F.round(clip(total, 0.0, 100.0), 2)


def survival(score: Column, cov: Column, g: Column) -> Column:
    return (
        F.when(cov < 0.01, "low").when((score >= 74) & (cov >= 0.07) & (g.isNull() | (g >= -0.12)), "high").when(score >= 45, "moderate").otherwise("low")
    )


def action(blur: Column, n: Column, cov: Column, chl: Column, g: Column) -> Column:
    return (
        F.when(blur < 120, "retake_photo").when((n >= 3) & (cov > 0.055), "thin_seedlings").when(chl >= 0.30, "check_nutrients")
        .when(g < -0.20, "check_roots").when(cov < 0.02, "increase_light").otherwise("maintain")
    )


def quality_flags_v1(blur: Column, brightness: Column, cov: Column) -> Column:
    flags = F.array(
        F.when(blur < 30, "blurry"), F.when(brightness < 45, "too_dark"), F.when(brightness > 225, "too_bright"), F.when(cov < 0.01, "low_coverage")
    )
    return F.coalesce(F.nullif(F.array_join(F.array_compact(flags), "|"), F.lit("")), F.lit("ok"))


def quality_flags_v2(fallback: Column, blur: Column, brightness: Column, inner: Column, cov: Column, most_spill: float = 0.32, least_cov: float = 0.01) -> Column:
    flags = F.array(
        F.when(fallback, "fallback_anchor"), F.when(blur < 45, "blur_low"), F.when(brightness < 40, "underexposed"), F.when(brightness > 225, "overexposed"),
        F.when(inner > most_spill, "neighbor_spill"), F.when(cov < least_cov, "low_signal"),
    )
    return F.coalesce(F.nullif(F.array_join(F.array_compact(flags), "|"), F.lit("")), F.lit("ok"))


def health_v2(cov: Column, g: Column, chl: Column, inner: Column, neighbor: Column, focus: Column, n: Column) -> Column:
    sure = clip(0.7 * focus + 0.3 * (1 - neighbor))
    grown = F.when(g.isNull(), 0.55).otherwise(clip((g + 0.30) / 1.10))
    total = 32 * F.least(cov / 0.08, F.lit(1.0)) + 18 * grown + 15 * (1 - F.least(chl * sure / 0.28, F.lit(1.0)))
    total = total + 15 * (1 - F.least((0.7 * inner + 0.3 * neighbor) / 0.5, F.lit(1.0))) + 12 * focus + 8 * F.greatest(F.lit(0.0), 1 - F.abs(n - 1.8) / 3)
    return F.round(clip(total, 0.0, 100.0), 2)


def readiness(focus: Column, inner: Column, cov: Column, g: Column) -> Column:
    return (
        F.when((focus >= 0.70) & (inner <= 0.16) & (cov >= 0.012), "high")
        .when((focus >= 0.46) & (inner <= 0.38) & (cov >= 0.006), "moderate")
        .when(g.isNotNull() & (focus >= 0.36), "moderate")
        .otherwise("low")
    )


def next_step(fallback: Column, focus: Column, inner: Column, neighbor: Column, cov: Column, chl: Column, n: Column, g: Column) -> Column:
    return (
        F.when(fallback | (focus < 0.35), "label_seed")
        .when((inner > 0.32) | ((neighbor > 0.60) & (focus < 0.55)), "disambiguate_neighbors")
        .when(cov < 0.012, "closer_photo")
        .when((chl >= 0.22) & (focus >= 0.62) & (inner <= 0.18) & (cov >= 0.02), "check_nutrients")
        .when((n >= 3) & (cov > 0.040), "thin_seedlings")
        .when(g < -0.18, "check_growth")
        .otherwise("ready")
    )


def plant_count(components: Column, cov: Column, dominant: Column, top: float = 0.07, heavy: float = 0.08) -> Column:
    by_cov = F.when(cov < 0.015, 1).when(cov < 0.03, 2).when(cov < top, 3).otherwise(4)
    n = F.least(components, F.lit(4), by_cov)
    n = F.when((dominant > heavy) & (n > 1), n - 1).otherwise(n)
    return F.when(components <= 0, F.when(cov >= 0.01, 1).otherwise(0)).otherwise(n)


def focus_score(neighbor: Column, anchor: Column, offset: Column, plant: Column) -> Column:
    return clip(0.5 * (1 - neighbor) + 0.35 * anchor + 0.10 * (1 - F.least(offset, F.lit(1.0))) + 0.05 * plant)


def seed_score(focus: Column, spill: Column, cov: Column) -> Column:
    return 0.65 * focus + 0.25 * (1 - spill) + 0.10 * F.least(cov, F.lit(0.12)) / 0.12


def severity(spill: Column, focus: Column, cov: Column, ready: Column) -> Column:
    penalty = F.when(ready == "low", 0.10).when(ready == "moderate", 0.05).when(ready == "high", 0.0).otherwise(0.03)
    return 0.70 * spill + 0.15 * (1 - focus) + 0.05 * clip(cov, 0.0, 0.08) / 0.08 + penalty


def signal_tier(matches: Column, numbers: Column) -> Column:
    return F.when(matches > 0, "ocr_match").when(numbers > 0, "weak_ocr").otherwise("no_signal")


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes struct(x, y, w, h), clamped to 0..1; 0 without area."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = w * h
    return clip(F.coalesce(both / F.nullif(a["w"] * a["h"] + b["w"] * b["h"] - both, F.lit(0.0)), F.lit(0.0)))


def batch_mode(rows: Column, expected: Column) -> Column:
    return F.when(rows == expected, "census").otherwise("mixed")
