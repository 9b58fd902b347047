"""Days in many overlapping intervals against comparing each with each."""

import datetime
import random

from pyspark.sql import functions as F

from fieldlens.operators import intervals, lookup, quality

DAY = datetime.date


def made(seed, n, m, width):
    rng = random.Random(seed)
    origin = DAY(1969, 6, 1).toordinal()
    spans = []
    for k in range(n):
        a = origin + rng.randrange(1000)
        spans.append((k, DAY.fromordinal(a), DAY.fromordinal(a + rng.randrange(-2, width)), rng.randrange(50)))
    return spans, [(DAY.fromordinal(origin + rng.randrange(-20, 1100)),) for _ in range(m)]


def test_first_interval_equals_all_pairs(spark):
    spans, days = made(1, 400, 300, 90)
    edge = [(1000, None, DAY(1970, 1, 1), 0), (1001, DAY(1970, 1, 1), None, 0), (1002, DAY(1, 1, 1), DAY(9999, 12, 31), 99)]
    s = spark.createDataFrame(spans + edge, "k long, a date, b date, priority int")
    d = spark.createDataFrame(days + [(None,), (DAY(1, 1, 1),), (DAY(9999, 12, 31),)], "day date")
    got = {r["day"]: r["found"]["k"] for r in intervals.first_holding(d, "day", s, "a", "b", ["priority", "k"], ["k"]).collect()}
    every = {day for (day,) in days} | {DAY(1, 1, 1), DAY(9999, 12, 31)}
    assert got == {day: min((p, k) for k, a, b, p in spans + edge if a and b and a <= day <= b)[1] for day in every}
    assert intervals.first_holding(d, "day", s.filter("false"), "a", "b", ["priority"], ["k"]).count() == 0


def test_last_day_within_equals_all_pairs(spark):
    spans, days = made(2, 300, 60, 40)
    s, d = spark.createDataFrame(spans, "k long, a date, b date, priority int"), spark.createDataFrame(days, "day date")
    got = {r["k"]: r["last"] for r in intervals.last_within(s, ["k"], "a", "b", d, "day", "last").collect()}
    want = {k: max((day for (day,) in days if a <= day <= b), default=None) for k, a, b, _ in spans}
    assert got == {k: v for k, v in want.items() if v}


def test_a_hundred_thousand_overlapping_phases(spark):
    """Phase k covers the days from k % 1000 on, 5000 of them, so each day is in tens of thousands."""
    k = F.col("id")
    text = lambda v: F.lit(v).cast("string")
    phases = spark.range(100_000).select(
        k.cast("string").alias("phase_id"), text(None).alias("phase_name"), F.when(k % 10 == 0, "other").alias("lifecycle_stage"), F.date_from_unix_date((k % 1000).cast("int")).alias("start_date"),
        F.date_from_unix_date((k % 1000 + 4999).cast("int")).alias("end_date"), text(None).alias("start_label"), text(None).alias("end_label"), (100_000 - k).alias("priority"),
    )
    runs = spark.range(0, 7000, 100).select(F.date_from_unix_date(k.cast("int")).alias("run_date"), k.alias("n"))
    got = {r["n"]: r["phase_id"] for r in lookup.phase_of(runs, phases, F.lit("sapling")).collect()}
    for n, found in got.items():
        # the greatest k of a stage that agrees whose window holds day n
        fits = [s for s in range(1000) if s <= n <= s + 4999 and s % 10]
        assert found == (str(99_000 + max(fits)) if fits else None)


def test_effective_ends_of_many_phases_equal_a_plain_walk(spark):
    rng = random.Random(4)
    origin = DAY(2026, 1, 1).toordinal()
    phases = []
    for i in range(200):
        a = None if i % 40 == 7 else DAY.fromordinal(origin + 2 * i)
        end = None if i % 9 == 0 else DAY.fromordinal(origin + 2 * i + rng.randrange(5))
        phases.append((f"p{i}", a, end, i, rng.choice([True, False, None])))
    days = sorted({DAY.fromordinal(origin + rng.randrange(400)) for _ in range(150)})
    got = {r[0]: (r[1], r[2]) for r in quality.effective_end(
        spark.createDataFrame(phases, "phase_id string, start_date date, end_date date, priority int, explicit_end boolean"), spark.createDataFrame([(d,) for d in days], "run_date date")).collect()}
    known = sorted((p for p in phases if p[1]), key=lambda p: (p[1], p[3]))
    after = {p[0]: q[1] for p, q in zip(known, known[1:])}
    for name, a, end, _, explicit in phases:
        nxt = after.get(name)
        run = max((d for d in days if a and nxt and a <= d < nxt), default=None)
        if end is None:
            want = (None, "missing_phase_end")
        elif not (a and nxt and nxt <= end):
            want = (end, "timeline_end")
        elif explicit:
            want = (end, "explicit_end_batch")
        else:
            want = (run, "latest_run_before_next") if run else (end, "no_run_before_next")
        assert got[name] == want, name
