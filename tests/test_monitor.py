"""Runs of the manifest monitor, their state, and runs that fail or come twice."""

import tempfile

import pytest

from fieldlens.streaming import monitor

MANIFEST = "asset_id string, capture_date string, captured_at string, photo_index string, row_index long"


def manifest(spark, *rows):
    return spark.createDataFrame([(a, d, f"{d} 10:00", "1", i) for i, (a, d) in enumerate(rows)], MANIFEST)


def counts(row):
    return tuple(row[c] for c in ("total_assets", "unique_dates", "added_count", "removed_count", "forward_added_count", "forward_removed_count"))


def test_runs_compare_with_what_the_last_one_kept(spark):
    root = "file://" + tempfile.mkdtemp(prefix="spark-")
    first = manifest(spark, ("a", "2026-01-01"), ("b", "2026-01-02"), (" b ", "2026-01-03"), ("", "2026-09-09"), (None, None), ("c", None))
    # b is one asset with its last date, while dates count all rows; a row without a date counts as the empty one
    row = monitor.observe(first, root, 1).first()
    assert counts(row) == (3, 4, 3, 0, 3, 0) and (row.comparison_source, row.latest_capture_date) == ("none", "2026-01-03")
    second = manifest(spark, ("b", "2026-01-03"), ("d", "2026-01-02"), ("e", "2026-01-03"), ("f", "2026-02-01"))
    row = monitor.observe(second, root, 2).first()
    assert counts(row) == (4, 3, 3, 2, 2, 0) and row.comparison_source == "run 1"
    assert {tuple(r) for r in monitor.moves_by_date(spark, root, 2).collect()} == {
        ("added", "2026-01-02", 1), ("added", "2026-01-03", 1), ("added", "2026-02-01", 1), ("removed", "2026-01-01", 1), ("removed", "", 1)}
    # a run that comes again does nothing, whatever it is given; an older one is refused; another manifest may be compared with
    assert counts(monitor.observe(first, root, 2).first()) == counts(row)
    with pytest.raises(ValueError):
        monitor.observe(first, root, 0)
    assert counts(monitor.observe(second, root, 3, compare=second).first()) == (4, 3, 0, 0, 0, 0)
    assert [r.run for r in monitor.history(spark, root).orderBy("run").collect()] == [1, 2, 3]


def test_a_run_that_failed_is_run_again(spark):
    root = "file://" + tempfile.mkdtemp(prefix="spark-")
    assert monitor.history(spark, root).count() == 0
    monitor.observe(manifest(spark, ("a", "2026-01-01")), root, 1)
    # its state was written, its history row was not
    monitor.assets(manifest(spark, ("x", "2027-01-01"))).write.parquet(f"{root}/state/run=2")
    assert monitor.runs(spark, root) == [1]
    row = monitor.observe(manifest(spark, ("a", "2026-01-01"), ("b", "2026-01-01")), root, 2).first()
    assert counts(row) == (2, 1, 1, 0, 1, 0) and row.comparison_source == "run 1"
    row = monitor.observe(manifest(spark).filter("false"), root, 3).first()
    assert counts(row) == (0, 0, 0, 2, 0, 2)
