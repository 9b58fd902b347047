"""Messages of identity resolution, the gate on them, and the cards and comparisons that show them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import lookup, report, resolve
from ..sources.shared import stored
from . import adapters as ad
from . import catalog, reviews
from .registry import oracle_sql, query

# what whole runs say, from rows m (run_date, row_index, subject_id, class_number, variety_name, dropped), row messages own
# and declared missing ids gone (run_date, m)
_RUNS = """kept AS (SELECT * FROM m WHERE dropped IS NULL),
each AS (SELECT run_date, subject_id, count(*) AS n, list_sort(list(DISTINCT variety_name) FILTER (variety_name IS NOT NULL)) AS names, list_sort(list(row_index)) AS idx FROM kept WHERE subject_id IS NOT NULL GROUP BY ALL),
by_class AS (SELECT run_date, class_number, list_sort(list(DISTINCT variety_name) FILTER (variety_name IS NOT NULL)) AS names FROM kept WHERE class_number IS NOT NULL GROUP BY ALL),
missing AS (SELECT run_date, list_sort(list(DISTINCT m)) AS ids FROM gone GROUP BY run_date),
runs AS (SELECT t.run_date, total, candidates, coalesce(s.n, 0) AS subjects, greatest(32 - coalesce(len(ids), 0), 0) AS effective, ids
  FROM (SELECT run_date, count(*) AS total, count(*) FILTER (dropped IS NULL) AS candidates FROM m GROUP BY run_date) t
  LEFT JOIN (SELECT run_date, count(*) AS n FROM each GROUP BY run_date) s USING (run_date) LEFT JOIN missing USING (run_date)),
messages AS (SELECT * FROM own
 UNION ALL SELECT run_date, 'error', 'duplicate_subject', subject_id, concat('pot ', subject_id, ': duplicate rows [', array_to_string(idx, ', '), ']') FROM each WHERE n > 1
 UNION ALL SELECT run_date, 'error', 'conflicting_names', subject_id, concat('pot ', subject_id, ': conflicting varieties [''', array_to_string(names, ''', '''), ''']') FROM each WHERE len(names) > 1
 UNION ALL SELECT run_date, 'warning', 'conflicting_class_names', CAST(class_number AS VARCHAR), concat('packet ', class_number, ': conflicting varieties [''', array_to_string(names, ''', '''), ''']') FROM by_class WHERE len(names) > 1
 UNION ALL SELECT run_date, 'error', 'subject_count', CAST(subjects AS VARCHAR), concat('unique_pot_count=', subjects, ' does not match expected_effective_pots=', effective, ' (expected_pots=32)') FROM runs WHERE subjects <> effective
 UNION ALL SELECT run_date, 'warning', 'other_rows', CAST(candidates AS VARCHAR), concat('run contains non-tomato/unknown rows: tomato_candidates=', candidates, ' total_rows=', total) FROM runs WHERE candidates <> total
 UNION ALL SELECT run_date, 'warning', 'declared_missing', CAST(len(ids) AS VARCHAR), concat('declared missing pots via manual row override: ', array_to_string(ids, ', ')) FROM runs WHERE ids IS NOT NULL)"""

_EXTRA = """SELECT run_date, 'warning' AS severity, 'extra_row' AS code, CAST(row_index AS VARCHAR) AS item, concat('row ', row_index, ': skipped extra row beyond expected_pots=32 with no explicit pot_id') AS text FROM fin WHERE dropped = 'extra'"""
_LATER = """SELECT run_date, 'warning', 'row_override_subject', CAST(row_index AS VARCHAR), concat('row ', row_index, ': manual row override pot_id=', o_subject, ' replaces inferred pot_id=', subject0) FROM fin WHERE live AND o_subject <> subject0
 UNION ALL SELECT run_date, 'warning', 'row_override_class', CAST(row_index AS VARCHAR), concat('row ', row_index, ': manual row override varietal=', o_class, ' replaces inferred varietal=', class0) FROM fin WHERE live AND o_class <> class0
 UNION ALL SELECT run_date, 'warning', 'row_override_variety', CAST(row_index AS VARCHAR), concat('row ', row_index, ': manual row override variety ''', o_name, ''' replaces inferred variety ''', name0, '''') FROM fin WHERE live AND lower(o_name) <> lower(name0)
 UNION ALL SELECT run_date, 'warning', 'excluded_row', CAST(row_index AS VARCHAR), concat('row ', row_index, ': excluded by manual row override') FROM fin WHERE dropped = 'excluded'
 UNION ALL SELECT run_date, 'error', 'missing_variety_name', CAST(row_index AS VARCHAR), concat('row ', row_index, ': tomato row is missing variety_name/species mapping') FROM fin WHERE dropped IS NULL AND variety_name IS NULL"""

_MESSAGES = f"""{catalog._RESOLVED.replace("fin AS (SELECT *,", "fin AS (SELECT *, dropped IS DISTINCT FROM 'extra' AS live,")},
gone AS (SELECT run_date, concat(CAST(event_id % 30 + 1 AS VARCHAR), 'T') AS m FROM intake WHERE event_id % 100 = 7), own AS ({_EXTRA} UNION ALL {_LATER}),
m AS (SELECT run_date, row_index, subject_id, class_number, variety_name, dropped FROM resolved), {_RUNS}"""


def _messages(spark, sf_dir):
    rows, over = catalog._resolved(spark, sf_dir)
    return resolve.run_messages(rows, over, 32)


@query(f"WITH {_MESSAGES} SELECT * FROM messages")
def run_messages(spark, sf_dir):
    return _messages(spark, sf_dir)


@query(f"""WITH {_MESSAGES}, days AS (SELECT DISTINCT run_date FROM intake), n AS (SELECT run_date, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM messages GROUP BY run_date)
SELECT run_date, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS passed FROM days LEFT JOIN n USING (run_date)""")
def run_gate(spark, sf_dir):
    return resolve.gate(_messages(spark, sf_dir), ad.intake(spark, sf_dir))


# intake whose class and name come from texts: packets named in notes, names of two kinds, numbers entered twice
_PACKETS = """intake AS (SELECT event_id + 1 AS row_index, CAST(ts AS DATE) AS run_date, concat('asset_', CAST(event_id AS VARCHAR)) AS asset, event_id,
  CASE WHEN event_id % 3 <> 0 THEN user_id % 40 + 1 END AS told, CASE WHEN event_id % 4 = 1 THEN event_id % 23 + 1 WHEN event_id % 4 = 2 THEN event_id % 19 + 1 END AS packet,
  CASE WHEN event_id % 5 = 0 THEN concat('Kind ', CAST(event_id % 7 AS VARCHAR)) WHEN event_id % 5 = 1 THEN (SELECT n_name FROM nation WHERE n_nationkey = event_id % 20) END AS derived, event_type = 'view' AS target FROM events),
series AS (SELECT n_nationkey + 1 AS series_number, CASE WHEN n_nationkey < 20 THEN n_name ELSE (SELECT n_name FROM nation n WHERE n.n_nationkey = nation.n_nationkey - 20) END AS series_name FROM nation),
fixed AS (SELECT concat(CAST(n_nationkey + 1 AS VARCHAR), 'T') AS subject_id, n_nationkey % 7 + 1 AS fixed_class FROM nation WHERE n_nationkey < 10),
base AS (SELECT concat(CAST(n_nationkey + 11 AS VARCHAR), 'T') AS subject_id, n_name AS baseline_name, n_nationkey + 1 AS baseline_class FROM nation WHERE n_nationkey < 20),
pos AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY row_index) AS run_position FROM intake),
seq AS (SELECT *, told IS NULL AS inferred, concat(CAST(coalesce(told, run_position) AS VARCHAR), 'T') AS subject_id, CASE WHEN told IS NULL AND run_position > 32 THEN 'extra' END AS dropped FROM pos),
cls AS (SELECT s.*, fixed_class, baseline_name, baseline_class, dropped IS NULL AS live, coalesce(fixed_class, baseline_class, packet) AS class_number FROM seq s LEFT JOIN fixed USING (subject_id) LEFT JOIN base USING (subject_id)),
nam AS (SELECT c.*, series_name AS class_name, coalesce(derived, series_name) AS name1 FROM cls c LEFT JOIN series ON series_number = class_number),
fin AS (SELECT *, CASE WHEN fixed_class IS NOT NULL THEN coalesce(class_name, name1) ELSE coalesce(baseline_name, name1) END AS variety_name FROM nam)"""


def _packets(spark, sf_dir):
    """(rows, overrides) of packets, with reviewed overrides for none."""
    n = ad.table(spark, sf_dir, "nation").withColumn("key", F.col("n_nationkey").cast("long"))
    e, k = ad.table(spark, sf_dir, "events"), F.col("event_id")
    first = F.broadcast(n.filter("key < 20").select(F.col("key").alias("k20"), F.col("n_name").alias("kind_name")))
    rows = e.join(first, k % 20 == F.col("k20")).select(
        (k + 1).alias("row_index"), F.to_date("ts").alias("run_date"), F.concat(F.lit("asset_"), k.cast("string")).alias("asset"),
        F.when(F.col("event_type") == "view", "tomato").otherwise("unknown").alias("label"),
        F.when(k % 3 != 0, F.concat((F.col("user_id") % 40 + 1).cast("string"), F.lit(" t"))).alias("pot_tag"),
        F.when(k % 4 == 1, F.concat(F.lit("packet_"), (k % 23 + 1).cast("string"))).alias("packet_tag"),
        F.when(k % 4 == 2, F.concat(F.lit("from packet_tag="), (k % 19 + 1).cast("string"))).otherwise("").alias("notes"),
        F.lit("").alias("caption"), F.lit("").alias("ocr_excerpt"),
        F.when(k % 5 == 0, F.concat(F.lit(" Kind "), (k % 7).cast("string"))).when(k % 5 == 1, "unknown").alias("variety_name"), F.when(k % 5 == 1, F.col("kind_name")).alias("species_common_name"),
    )
    # numbers above 20 repeat the names of the first, and are entered before them
    low = n.select(F.col("key").alias("low"), F.col("n_name").alias("low_name"))
    series = n.join(low, F.when(F.col("key") < 20, F.col("key")).otherwise(F.col("key") - 20) == F.col("low")).select((F.col("key") + 1).alias("series_number"), F.col("low_name").alias("series_name"), (-F.col("key")).alias("row_index"))
    fixed, base = ad.dims(spark, sf_dir)[1:]
    over = ad.overrides(ad.intake(spark, sf_dir)).withColumn("reviewed", F.lit("no"))
    return resolve.resolve_identities(rows, series, fixed, base, over, resolve.Params(name_fallback=True)), over


@query(f"""WITH {_PACKETS} SELECT run_date, row_index, subject_id, class_number, variety_name, dropped, date_diff('day', DATE '2026-02-24', run_date) AS day_since_potting,
 date_diff('day', DATE '2026-02-25', run_date) + 1 AS experiment_day, NOT coalesce(class_name = variety_name, TRUE) AS class_name_differs,
 CASE WHEN variety_name IS NULL THEN 'ocr' ELSE 'none' END AS review_stage,
 concat_ws('; ', CASE WHEN inferred THEN 'pot_id_inferred_from_run_sequence' END, CASE WHEN NOT target THEN 'label_not_tomato_run_assumed_tomato' END,
  CASE WHEN event_id % 4 = 2 AND concat(CAST(packet AS VARCHAR), 'T') = subject_id THEN 'ocr_confirms_pot_number' END,
  CASE WHEN class_name IS NOT NULL THEN 'variety_from_series_number_map' END, CASE WHEN fixed_class IS NOT NULL THEN 'series_from_manual_pot_override' END,
  CASE WHEN fixed_class IS NULL AND baseline_class IS NOT NULL AND packet IS DISTINCT FROM baseline_class THEN 'series_from_baseline_pot_mapping' END,
  CASE WHEN fixed_class IS NULL AND lower(name1) <> lower(baseline_name) THEN 'variety_from_baseline_pot_mapping' END, CASE WHEN variety_name IS NULL THEN 'missing_variety_name' END) AS mapping_note FROM fin""")
def packet_rows(spark, sf_dir):
    out = _packets(spark, sf_dir)[0].select("run_date", "row_index", "subject_id", "class_number", "variety_name", "dropped", "day_since_potting", "experiment_day", "class_name_differs", "review_stage", "mapping_note")
    return out.withColumns({c: F.col(c).cast("long") for c in ("day_since_potting", "experiment_day")})


_WARN = "SELECT run_date, 'warning', {code}, CAST(row_index AS VARCHAR), concat('row ', row_index, {text}) FROM fin WHERE live AND {test}"
_PACKET_OWN = " UNION ALL ".join([
    _EXTRA,
    _WARN.format(code="'override_series'", text="': pot ', subject_id, ' override series=', fixed_class, ' replaces detected series=', packet", test="fixed_class <> packet"),
    _WARN.format(code="'baseline_series'", text="': baseline series=', baseline_class, ' replaces detected series=', packet, ' for pot ', subject_id", test="fixed_class IS NULL AND baseline_class <> packet"),
    _WARN.format(code="'override_variety'", text="': pot ', subject_id, ' override variety ''', class_name, ''' replaces detected variety ''', name1, ''''", test="fixed_class IS NOT NULL AND lower(class_name) <> lower(name1)"),
    _WARN.format(code="'baseline_variety'", text="': baseline variety ''', baseline_name, ''' replaces detected variety ''', name1, ''' for pot ', subject_id", test="fixed_class IS NULL AND lower(baseline_name) <> lower(name1)"),
    _WARN.format(code="'packet_name'", text="': packet_number=', class_number, ' maps to ''', class_name, ''' but row variety is ''', variety_name, ''''", test="lower(class_name) <> lower(variety_name)"),
    "SELECT run_date, 'error', 'missing_variety_name', CAST(row_index AS VARCHAR), concat('row ', row_index, ': tomato row is missing variety_name/species mapping') FROM fin WHERE live AND variety_name IS NULL",
])


@query(f"WITH {_PACKETS}, m AS (SELECT * FROM fin), gone AS (SELECT NULL::DATE AS run_date, NULL::VARCHAR AS m LIMIT 0), own AS ({_PACKET_OWN}), {_RUNS} SELECT * FROM messages")
def packet_messages(spark, sf_dir):
    rows, over = _packets(spark, sf_dir)
    return resolve.run_messages(rows, over, 32)


# ---- cards and comparison


@query(f"""WITH cmp AS ({oracle_sql()["run_comparison"]}), msg AS (WITH {_MESSAGES} SELECT * FROM messages WHERE run_date = (SELECT max(run_date) FROM intake) AND severity = 'warning'),
n AS (SELECT concat(regexp_extract(text, '\\bpot ([0-9]+)T\\b', 1), 'T') AS subject_id, count(*) AS n FROM msg WHERE regexp_matches(text, '\\bpot [0-9]{{1,3}}T\\b') GROUP BY 1)
SELECT subject_id, variety_name, status, coalesce(n, 0) AS warnings FROM cmp LEFT JOIN n USING (subject_id)""")
def subject_cards(spark, sf_dir):
    rows, over = catalog._kept(spark, sf_dir)
    messages = resolve.run_messages(rows, over, 32).filter("severity = 'warning'")
    last = ad.intake(spark, sf_dir).agg(F.max("run_date").alias("last"))
    latest = messages.join(F.broadcast(last), F.col("run_date") == F.col("last"))
    return report.subject_cards(catalog._comparison(spark, rows), latest, "text").select("subject_id", "variety_name", "status", "warnings")


@query(f"""WITH cmp AS ({oracle_sql()["run_comparison"]}), crd AS (WITH {reviews._CARDS} SELECT *, row_number() OVER (ORDER BY run_date DESC) AS k FROM cards),
w AS (WITH {_MESSAGES} SELECT run_date, count(*) AS warnings FROM messages WHERE severity = 'warning' GROUP BY run_date), c AS (SELECT * FROM crd LEFT JOIN w USING (run_date)),
j AS (SELECT (SELECT count(*) FROM cmp WHERE status = 'risk') AS at_risk, (SELECT count(*) FROM cmp WHERE status = 'info') AS partial, a.rows AS rows_a, a.confirmed_rows AS confirmed_a, coalesce(a.warnings, 0) AS warnings_a,
  b.rows AS rows_b, b.confirmed_rows AS confirmed_b, coalesce(b.warnings, 0) AS warnings_b FROM (SELECT * FROM c WHERE k = 2) a, (SELECT * FROM c WHERE k = 1) b)
SELECT *, CASE WHEN rows_b = 32 AND rows_a > 32 THEN 'census_after_sweep' WHEN rows_b = 32 THEN 'complete' ELSE 'batch' END AS headline FROM j""")
def comparison_insight(spark, sf_dir):
    rows, over = catalog._kept(spark, sf_dir)
    cards = stored(reviews._cards(rows), "run-cards")
    days = [r["run_date"] for r in cards.select("run_date").orderBy(F.desc("run_date")).limit(2).collect()]
    first, second = lookup.run_pair(days)
    return report.comparison_insight(catalog._comparison(spark, rows), cards, resolve.run_messages(rows, over, 32), first, second, 32)


# ---- texts of boxes

_TEXTS = """b AS (SELECT l_orderkey AS photo, l_linenumber AS ord, l_partkey AS part, l_suppkey % 12 + 1 AS c, l_orderkey % 9 AS f FROM lineitem),
t AS (SELECT photo, CASE WHEN f IN (0, 2, 3) THEN 'varietal' WHEN f = 6 OR (f = 4 AND c < 10) THEN 'pot' WHEN f = 8 THEN 'unlabeled' ELSE 'other' END AS kind,
 CASE WHEN f IN (0, 2, 3) THEN CAST(c AS VARCHAR) WHEN f = 6 OR (f = 4 AND c < 10) THEN concat(CAST(c AS VARCHAR), 'T') END AS value FROM b)"""


def _texts(spark, sf_dir):
    c, f = (F.col("l_suppkey") % 12 + 1).cast("string"), F.col("l_orderkey") % 9
    forms = [("varietal ", c, ""), ("Variety ", c, ""), ("VARIET number", c, " here"), ("", c, " variet"), ("tag for Pot 00", c, " t"), ("1234", F.lit(""), "T pot"), ("", c, "t in the POT"), ("varietal 1234", F.lit(""), "")]
    says = F.lit("  ")
    for i, (a, mid, z) in enumerate(forms):
        says = F.when(f == i, F.concat(F.lit(a), mid, F.lit(z))).otherwise(says)
    kind = text.annotation_kind(says)
    return ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("photo"), kind.alias("k")).select("photo", "k.kind", "k.value")


@query(f"WITH {_TEXTS} SELECT photo, kind, value, count(*) AS n FROM t GROUP BY ALL")
def box_text_kinds(spark, sf_dir):
    return _texts(spark, sf_dir).groupBy("photo", "kind", "value").agg(F.count("*").alias("n"))


@query(f"WITH {_TEXTS} SELECT photo, kind, value, count(*) AS n FROM t WHERE kind IN ('pot', 'varietal') GROUP BY ALL")
def box_values(spark, sf_dir):
    return report.box_values(_texts(spark, sf_dir), "photo")
