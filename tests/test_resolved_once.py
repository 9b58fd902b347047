"""Plans that read resolved rows several times resolve them once."""

import datetime

import pytest

from fieldlens.operators import lookup, resolve
from fieldlens.plans import catalog, evidence

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", [evidence.comparison_insight, evidence.subject_cards])
def test_rows_are_resolved_once(spark, monkeypatch, query):
    calls, real = [], resolve.resolve_identities
    monkeypatch.setattr(resolve, "resolve_identities", lambda *a, **k: calls.append(1) or real(*a, **k))
    assert query(spark, SF).count() == (1 if query is evidence.comparison_insight else 32)
    assert len(calls) == 1


def test_both_runs_come_from_stored_rows(spark):
    assert all("resolved-rows" in f for f in catalog.run_comparison(spark, SF).inputFiles())


def test_names_before_and_after_overrides_are_told_by_one_index(spark, monkeypatch):
    calls, real = [], lookup.told_index
    monkeypatch.setattr(resolve, "told_index", lambda *a, **k: calls.append(1) or real(*a, **k))
    rows, over = evidence._packets(spark, SF)
    assert len(calls) == 1 and rows.count() == 1000


def test_told_index_is_of_strictly_earlier_runs(spark):
    day = lambda d: datetime.date(2024, 1, d)
    known = spark.createDataFrame([(1, day(1), 5, "a"), (1, day(2), 4, "b"), (2, day(2), 1, "c")], "number long, run_date date, row_index long, v string")
    asked = spark.createDataFrame([(1, day(1)), (1, day(2)), (1, day(3)), (2, day(2)), (2, day(4)), (None, day(4))], "number long, run_date date")
    got = {(r.number, r.run_date.day): r.v for r in lookup.told_index(asked, known, "number", "v").collect()}
    assert got == {(1, 2): "a", (1, 3): "a", (2, 4): "c"}
