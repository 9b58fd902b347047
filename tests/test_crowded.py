"""Photos with thousands of boxes against the fold of small ones."""

import numpy as np
import pytest

from fieldlens.operators import boxes, crowded

SUBJECT = "photo long, ord int, cx double, cy double, expected long"
CLASS = "photo long, ord int, cx double, cy double, class_number long"


def made(seed, photos, n, m):
    rng = np.random.default_rng(seed)
    grid = lambda: float(rng.integers(0, 40)) / 40  # noqa: E731  equal distances occur
    s = [(p, i, grid(), grid(), int(rng.integers(1, 5)) if rng.integers(4) else None) for p in range(photos) for i in range(n)]
    c = [(p, i, grid(), grid(), int(rng.integers(1, 5)) if rng.integers(5) else None) for p in range(photos) for i in range(m)]
    return s, c


def test_pairs_equal_the_fold(spark, monkeypatch):
    s, c = made(1, 12, 9, 7)
    s, c = spark.createDataFrame(s, SUBJECT), spark.createDataFrame(c, CLASS)
    folded = sorted(map(tuple, boxes.paired(s, c, "photo").collect()))
    monkeypatch.setattr(boxes, "FOLDED_PAIRS", 0)
    assert sorted(map(tuple, boxes.paired(s, c, "photo").collect())) == folded and len(folded) == 12 * 7


def test_suppression_equals_the_fold(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(p, i, int(rng.integers(1, 3)), float(rng.random()), float(rng.random()), float(rng.random() / 4), float(rng.random() / 4)) for p in range(8) for i in range(40)]
    df = spark.createDataFrame(rows, "photo long, ord int, class_number long, x double, y double, w double, h double")
    folded = sorted(map(tuple, boxes.suppressed(df, "photo", near=0.05, overlap=0.3).collect()))
    monkeypatch.setattr(boxes, "FOLDED_BOXES", 0)
    assert sorted(map(tuple, boxes.suppressed(df, "photo", near=0.05, overlap=0.3).collect())) == folded and 0 < len(folded) < len(rows)


def test_a_photo_with_five_thousand_boxes_of_each_kind(spark):
    rng = np.random.default_rng(5)
    s, c = rng.random((2, 5000)), rng.random((2, 5000))
    expected, numbers = rng.integers(1, 40, 5000).astype(float), rng.integers(1, 40, 5000).astype(float)
    table = lambda xy, k: [(1, i, float(x), float(y), int(v)) for i, (x, y, v) in enumerate(zip(*xy, k))]
    found = boxes.paired(spark.createDataFrame(table(s, expected), SUBJECT), spark.createDataFrame(table(c, numbers), CLASS), "photo").collect()
    assert len(found) == 5000 and len({r["subject_ord"] for r in found}) == len({r["class_ord"] for r in found}) == 5000
    # no free pair would have gone before the pairs that its two boxes are in
    by_s, by_c = {r["subject_ord"]: r for r in found}, {r["class_ord"]: r for r in found}
    for i in range(0, 5000, 97):
        far = np.sqrt(((c - s[:, i : i + 1]) ** 2).sum(axis=0))
        passes = np.where(numbers == expected[i], 1, 2)
        mine = (by_s[i]["pass_no"], by_s[i]["distance"])
        for j in np.flatnonzero((passes < mine[0]) | ((passes == mine[0]) & (far < mine[1] - 1e-12))):
            other = by_c[int(j)]
            assert (other["pass_no"], other["distance"]) <= (passes[j], far[j] + 1e-12)
    spots = spark.createDataFrame([(1, i, 1, float(i % 50) / 50, float(i // 50) / 50, 0.02, 0.02) for i in range(5000)], "photo long, ord int, class_number long, x double, y double, w double, h double")
    assert boxes.suppressed(spots, "photo", near=0.001).count() == 5000 and boxes.suppressed(spots, "photo", near=0.02 + 1e-9).count() == 1250 * 2


@pytest.mark.parametrize("n", [0, 1])
def test_no_boxes(spark, n):
    s, c = made(1, 1, n, 0)
    assert boxes.paired(spark.createDataFrame(s, SUBJECT), spark.createDataFrame(c, CLASS), "photo").count() == 0
    assert crowded.kept_boxes(*(np.zeros(0) for _ in range(4)), 0.1, 0.5) == []


def test_verdicts_of_crowded_photos_and_of_boxes_without_a_photo(spark, monkeypatch):
    s, c = made(7, 12, 9, 7)
    # equal orders, photos with one kind of boxes only, and boxes without a photo
    s += [(0, 3, 0.5, 0.5, 2), (50, 1, 0.1, 0.1, 1), (None, 1, 0.2, 0.2, 1), (None, 2, 0.2, 0.2, 1)]
    c += [(60, 1, 0.1, 0.1, 1), (None, 1, 0.2, 0.2, 1)]
    s, c = spark.createDataFrame(s, SUBJECT), spark.createDataFrame(c, CLASS)
    found = boxes.verdicts(s, c, "photo")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert sum(r["subject_ord"] is not None for r in rows) == 12 * 9 + 4
    assert sorted((r["subject_ord"], r["class_ord"]) for r in rows if r["photo"] is None and r["subject_ord"]) == [(1, None), (2, None)]
    assert [(r["class_ord"], r["evidence_type"]) for r in rows if r["photo"] == 60] == [(1, "varietal_only")]
    rest = lambda t: sorted((tuple(r) for r in t if r["photo"] != 0), key=str)
    monkeypatch.setattr(boxes, "FOLDED_PAIRS", -1)
    assert rest(boxes.verdicts(s, c, "photo").collect()) == rest(rows)
