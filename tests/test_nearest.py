"""Nearest templates that skip pieces against comparing each with each."""

import numpy as np
from pyspark.sql import functions as F

from fieldlens.operators import nearest, similarity


def templates_of(spark, rows):
    return spark.createDataFrame(rows, "s long, v array<double>").select("s", similarity.unit(F.col("v")).alias("template"))


def clustered(seed, groups, each, width=8, noise=0.03):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return (np.repeat(centres, each, axis=0) + rng.normal(size=(groups * each, width)) * noise).tolist()


def compare(spark, targets, known, k, pivots, piece):
    plain = sorted(map(tuple, similarity.matches(targets, "v", known, "s", "k", k).collect()), key=str)
    got = sorted(map(tuple, nearest.nearest(targets, "v", known, "s", "k", k, pivots, piece).collect()), key=str)
    assert got == plain
    return got


def test_equals_all_pairs_and_skips_most(spark):
    points = clustered(1, 20, 100)
    known = templates_of(spark, list(enumerate(points)))
    targets = spark.createDataFrame(list(enumerate(points[::25])), "k long, v array<double>")
    assert len(compare(spark, targets, known, 3, 40, 25)) == 80 * 3
    (r,) = nearest.pruning(targets, "v", known, "s", "k", 3, 40, 25).collect()
    assert (r.targets, r.templates, r.pairs) == (80, 2000, 160_000) and r.met < r.pairs / 4


def test_no_direction_repeated_rows_and_ties(spark):
    points = clustered(2, 3, 20, width=3)
    # equal templates tie, some have no direction, and a target has none, is null, or comes twice
    rows = list(enumerate(points)) + [(100 + i, points[0]) for i in range(30)] + [(200, [0.0, 0.0, 0.0]), (-5, [0.0, 0.0, 0.0])]
    known = templates_of(spark, rows)
    targets = spark.createDataFrame([(1, points[0]), (1, points[0]), (2, [0.0, 0.0, 0.0]), (3, None), (4, [-x for x in points[30]])], "k long, v array<double>")
    for k, pivots, piece in ((3, 4, 5), (40, 2, 7), (200, 8, 1000)):
        compare(spark, targets, known, k, pivots, piece)


def test_random_vectors_without_clusters(spark):
    rng = np.random.default_rng(3)
    known = templates_of(spark, [(i, v) for i, v in enumerate(rng.normal(size=(300, 16)).tolist())])
    targets = spark.createDataFrame(list(enumerate(rng.normal(size=(40, 16)).tolist())), "k long, v array<double>")
    compare(spark, targets, known, 5, 8, 20)


def test_nothing_known_and_no_targets(spark):
    known = templates_of(spark, [(1, [1.0, 0.0])])
    targets = spark.createDataFrame([(1, [1.0, 0.5])], "k long, v array<double>")
    assert nearest.nearest(targets, "v", known.filter("false"), "s", "k").count() == 0
    assert nearest.nearest(targets.filter("false"), "v", known, "s", "k").count() == 0
    zero = templates_of(spark, [(1, [0.0, 0.0]), (2, [0.0, 0.0])])
    assert [tuple(r) for r in nearest.nearest(targets, "v", zero, "s", "k", k=1).collect()] == [(1, 1, 0.0, 1)]


def test_norms_once_a_vector_and_blocks_of_targets(spark, monkeypatch):
    rng = np.random.default_rng(4)
    known = templates_of(spark, list(enumerate(rng.normal(size=(400, 12)).tolist())))
    # the norm of a vector is worked out beside its elements, not for each of them
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("sqrt") == 1
    targets = spark.createDataFrame(list(enumerate(rng.normal(size=(90, 12)).tolist())), "k long, v array<double>")
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "SPAN", 2)
    compare(spark, targets, known, 7, 4, 10)


def test_subjects_that_are_texts_and_many_ties(spark):
    points = clustered(5, 2, 10, width=4)
    rows = [(f"s{i:03}", points[i % 20]) for i in range(400)]
    known = spark.createDataFrame(rows, "s string, v array<double>").select("s", similarity.unit(F.col("v")).alias("template"))
    targets = spark.createDataFrame(list(enumerate(points)), "k long, v array<double>")
    compare(spark, targets, known, 25, 3, 30)
