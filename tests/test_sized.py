"""Queries on rows that the small driver tables do not have."""

import duckdb
import pytest

from fieldlens.plans import evidence, registry, worklists  # noqa: F401  these import the modules whose queries are used here


def write(tmp_path, **tables):
    """Each table's SQL, written to a Parquet file."""
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    return con


def both(spark, con, tmp_path, name):
    """(Spark's rows, DuckDB's rows) of a query, with columns in DuckDB's order."""
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    return sorted(map(tuple, got), key=str), sorted(want.fetchall(), key=str)


def test_numbers_of_more_than_three_digits_are_no_subject(spark, tmp_path):
    con = write(tmp_path, events="SELECT i AS event_id, u AS user_id, 'view' AS event_type FROM (VALUES (1, 7), (2, 42), (3, 999), (4, 1000), (5, 12345), (6, 0)) t(i, u)")
    got, want = both(spark, con, tmp_path, "id_normalisation")
    assert got == want


def test_a_mean_on_the_limit_has_no_flag(spark, tmp_path):
    con = write(tmp_path, part="SELECT 1 AS p_partkey", lineitem="SELECT 1 AS l_partkey, 0.03::DOUBLE AS l_discount, 0.0::DOUBLE AS l_tax, 30.0::DOUBLE AS l_quantity, 1100.0::DOUBLE AS l_extendedprice")
    got, want = both(spark, con, tmp_path, "metric_flags")
    assert got == want == [(1, "ok")]


@pytest.mark.parametrize("name", ["early_scores", "label_queue", "metric_flags", "metric_scores", "metric_summary", "page_stats", "reference_subjects", "routed_rows"])
def test_means_on_limits_follow_the_order_of_the_table(spark, tmp_path, name):
    con = write(tmp_path, part="SELECT i AS p_partkey FROM range(2000) t(i)")
    con.execute("SET threads TO 1")
    # every part's nine discounts and taxes, twice each, have their mean on a limit; its rows lie in four files
    spread = "(i // 2000 + i % 2000) * [1, 2, 4, 5, 7, 8][i % 2000 % 6 + 1] % 9 - 4"
    amounts = f"(CASE i % 2000 % 3 WHEN 0 THEN 4 ELSE 5 END + {spread}) / 100.0 AS l_discount, (CASE i % 2 WHEN 0 THEN 4 ELSE 6 END + {spread}) / 100.0 AS l_tax, (36 + hash(i, 'q') % 15)::DOUBLE AS l_quantity, (90000 + (hash(i, 'p') % 10000000)::BIGINT) / 100.0 AS l_extendedprice"
    (tmp_path / "lineitem.parquet").mkdir()
    for f in range(4):
        con.execute(f"COPY (SELECT i % 2000 AS l_partkey, {amounts} FROM range({f} * 9000, {f + 1} * 9000) t(i)) TO '{tmp_path}/lineitem.parquet/{f}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got, want = both(spark, con, tmp_path, name)
    assert got == want


def test_all_rows_of_a_subject_are_listed(spark, tmp_path):
    # one run with more than 10000 rows of one subject, whose numbers lie far apart
    events = "SELECT i * 17 AS event_id, TIMESTAMP '2026-03-01 08:00:00' AS ts, 7 AS user_id, 'view' AS event_type, 1.0 AS value FROM range(18000) t(i) ORDER BY hash(i)"
    con = write(tmp_path, events=events, nation="SELECT * FROM '/root/testdata/sf0.001/nation.parquet'")
    got, want = both(spark, con, tmp_path, "packet_messages")
    assert got == want
    assert max(r[-1].count(", ") for r in map(tuple, want) if "duplicate_subject" in r) >= 10_000
