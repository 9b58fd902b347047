"""Registered queries for work-lists, routing, summaries and orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, scores, text
from ..operators import boxes, lookup, merge, quality, rank, report, resolve, season, select
from . import adapters as ad
from . import catalog, records, reviews
from .registry import oracle_sql, query

_LAST = "(SELECT max(run_date) FROM intake)"


def _listing(rows):
    """Images that are there: every third row of the intake, some of them twice."""
    some = rows.filter("event_id % 3 = 0").select("row_index", "asset")
    return some.unionByName(some.filter("row_index % 2 = 0"))


@query(f"WITH {ad.INTAKE} SELECT row_index, asset FROM intake WHERE run_date = {_LAST}")
def latest_run(spark, sf_dir):
    return select.of_run(ad.intake(spark, sf_dir)).select("row_index", "asset")


@query(f"WITH {ad.INTAKE} SELECT row_index FROM intake WHERE label = 'non_tomato'")
def label_rows(spark, sf_dir):
    return select.of_label(ad.intake(spark, sf_dir), "non_tomato").select("row_index")


def _interest(spark, sf_dir):
    c = F.col("user_id") % 6
    caption = F.when(c == 0, "Kale | non_tomato_03 | unknown").when(c == 1, "Early Girl | p1 | x").when(c == 2, "two Tomatoes | p2 | y").when(c == 3, "early girl").when(c == 4, "girl").otherwise("tomatoless")
    return select.of_interest(ad.intake(spark, sf_dir).withColumn("caption", caption), ["early_girl", "sungold", ""])


_INTEREST = "label = 'tomato' OR (label <> 'non_tomato' AND user_id % 6 IN (1, 2, 3))"


@query(f"WITH {ad.INTAKE} SELECT row_index, {_INTEREST} AS skip FROM intake")
def interest_rows(spark, sf_dir):
    return _interest(spark, sf_dir).select("row_index", "skip")


@query(f"WITH {ad.INTAKE} SELECT count(*) FILTER (NOT ({_INTEREST})) AS kept, count(*) FILTER ({_INTEREST}) AS skipped FROM intake")
def interest_counts(spark, sf_dir):
    return select.skip_counts(_interest(spark, sf_dir))


@query(f"WITH {ad.INTAKE} SELECT row_index FROM intake WHERE run_date = {_LAST} AND row_index BETWEEN 100 AND (SELECT max(row_index) - 3 FROM intake WHERE run_date = {_LAST})")
def range_rows(spark, sf_dir):
    rows = ad.intake(spark, sf_dir)
    last = rows.agg(F.max("run_date")).first()[0]
    top = rows.filter(F.col("run_date") == F.lit(last)).agg(F.max("row_index")).first()[0]
    return select.of_range(rows, last, 100, top - 3).select("row_index")


@query(f"WITH m AS ({oracle_sql()['metric_scores']}) SELECT part FROM m WHERE next_step = 'ready' AND part % 5 <> 0")
def routed_rows(spark, sf_dir):
    m = catalog.metric_scores(spark, sf_dir).withColumn("subject_id", F.when(F.col("part") % 5 != 0, F.col("part").cast("string")).otherwise(" "))
    return select.routed(m, "ready").select("part")


@query(f"WITH {ad.INTAKE} SELECT row_index, CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 3 = 0 THEN 'present' ELSE 'fetch' END AS state FROM intake")
def fetch_list(spark, sf_dir):
    rows = ad.intake(spark, sf_dir)
    return select.work_state(rows.withColumn("photo_url", F.when(F.col("event_id") % 7 != 0, "u").otherwise(" ")), _listing(rows)).select("row_index", "state")


@query(f"WITH {ad.INTAKE} SELECT row_index FROM intake WHERE run_date = {_LAST} AND event_id % 3 = 0 ORDER BY row_index LIMIT 25")
def latest_images(spark, sf_dir):
    rows = ad.intake(spark, sf_dir)
    return select.latest_images(rows, _listing(rows), 25).select("row_index")


@query(f"""WITH {catalog._RESOLVED} SELECT run_date, row_index, subject_id FROM resolved WHERE dropped IS NULL AND (row_index - 1) % 3 = 0 AND CAST(replace(subject_id, 'T', '') AS BIGINT) > 0""")
def focus_rows(spark, sf_dir):
    rows, _ = catalog._resolved(spark, sf_dir)
    return select.focus_rows(rows, _listing(ad.intake(spark, sf_dir)), rows.select("run_date")).select("run_date", "row_index", "subject_id")


@query(f"""WITH {catalog._RESOLVED}, d AS (SELECT DISTINCT run_date FROM resolved ORDER BY run_date DESC LIMIT 2)
SELECT concat(strftime(run_date, '%Y-%m-%d'), '::', CAST(row_index AS VARCHAR), '::asset_', CAST(row_index - 1 AS VARCHAR)) AS photo_key, subject_id FROM resolved WHERE dropped IS NULL AND run_date IN (SELECT run_date FROM d)""")
def photo_set(spark, sf_dir):
    days = [r["d"] for r in ad.intake(spark, sf_dir).select(F.col("run_date").alias("d")).distinct().orderBy(F.desc("d")).limit(2).collect()]
    return select.photo_set(catalog._resolved(spark, sf_dir)[0], *lookup.run_pair(days)).select("photo_key", "subject_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'from alias' WHEN c_custkey % 3 = 1 THEN 'from profile' ELSE nullif(trim(c_mktsegment), '') END AS note, CASE WHEN c_custkey % 3 = 1 THEN 'sci' ELSE c_name END AS scientific FROM customer""")
def profile_rows(spark, sf_dir):
    k = F.col("c_custkey") % 3
    rows = ad.table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(k == 0, "  Old   NAME").when(k == 1, "New Name ").otherwise("other").alias("variety_name"), F.col("c_mktsegment").alias("note"), F.col("c_name").alias("scientific")
    )
    profiles = spark.createDataFrame([("new name", "from profile", "sci"), ("older", "from alias", "")], "key string, note string, scientific string")
    return select.enriched(rows, profiles, spark.createDataFrame([("old name", "older")], "key string, profile_key string"), "variety_name", ["note", "scientific"]).select("c_custkey", "note", "scientific")


# ---- scores and texts


@query(f"""WITH {ad.METRICS}, f AS (SELECT part, concat_ws('|', CASE WHEN part % 11 = 0 THEN 'fallback_anchor' END, CASE WHEN blur < 45 THEN 'blur_low' END, CASE WHEN brightness < 40 THEN 'underexposed' END, CASE WHEN brightness > 225 THEN 'overexposed' END,
 CASE WHEN inner_spill > 0.2 THEN 'neighbor_spill' END, CASE WHEN coverage < 0.03 THEN 'low_signal' END) AS f FROM metrics) SELECT part, CASE WHEN f = '' THEN 'ok' ELSE f END AS flags FROM f""")
def metric_flags(spark, sf_dir):
    flags = scores.quality_flags_v2(F.col("part") % 11 == 0, F.col("blur"), F.col("brightness"), F.col("inner_spill"), F.col("coverage"), most_spill=0.2, least_cov=0.03)
    return ad.metrics(spark, sf_dir).select("part", flags.alias("flags"))


@query("""SELECT l_orderkey, l_linenumber, printf('%.1f%%', l_discount * 100) AS share, CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_discount > 0 THEN concat('+', printf('%.1f%%', l_discount * 100)) ELSE '0.0%' END AS signed,
 CASE WHEN l_linenumber % 2 = 0 THEN 'high' ELSE 'unknown' END AS readiness, CASE l_returnflag WHEN 'A' THEN 'ready' ELSE 'review' END AS badge, CASE l_returnflag WHEN 'N' THEN 'unknown' ELSE concat('ready x', l_returnflag) END AS spoken FROM lineitem""")
def display_texts(spark, sf_dir):
    d, even = F.col("l_discount"), F.col("l_linenumber") % 2 == 0
    return ad.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text.percent_text(d).alias("share"), text.percent_text(F.when(F.col("l_linenumber") % 4 != 0, d), signed=True).alias("signed"),
        text.low_domain(F.when(even, " HIGH").otherwise("odd")).alias("readiness"), text.badge(F.when(F.col("l_returnflag") == "A", " ready_x").otherwise("other")).alias("badge"),
        text.spoken(F.when(F.col("l_returnflag") != "N", F.concat(F.lit("ready_x"), F.col("l_returnflag"))).otherwise(" ")).alias("spoken"),
    )


@query("""SELECT o_orderkey, concat('seed_', CAST(o_orderkey % 9 AS VARCHAR), '_', CAST(o_custkey AS VARCHAR), 't') AS task_key, CAST(least(100, round_even(o_orderkey % 250 / 200.0 * 100, 0)) AS INT) AS percent,
 CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE concat('a_', CAST(o_custkey AS VARCHAR)) END AS token, list_filter([CASE WHEN o_custkey <> o_orderkey THEN o_custkey END, o_orderkey], lambda x: x > 0) AS numbers,
 CASE WHEN o_orderkey % 4 = 0 THEN 1 WHEN o_orderkey % 4 = 1 THEN 3 WHEN o_orderkey % 4 = 2 THEN 0 ELSE 2 END AS plants, 12.3 AS latitude FROM orders""")
def small_texts(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = k % 4
    plants = scores.plant_count(F.when(m == 2, 0).otherwise(3), F.when(m == 0, 0.01).when(m == 1, 0.05).when(m == 2, 0.001).otherwise(0.05), F.when(m == 3, 0.09).otherwise(0.01))
    return ad.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.task_key("seed", k % 9, F.concat(c.cast("string"), F.lit("T")), F.lit("")).alias("task_key"), text.confidence_percent((k % 250 / 200.0).cast("string")).alias("percent"),
        ids.token(F.when(k % 3 != 0, F.concat(F.lit(" a "), c.cast("string"), F.lit("!"))).otherwise("!"), "none").alias("token"),
        ids.number_list(F.concat(c.cast("string"), F.lit(", x,0,"), k.cast("string"))).alias("numbers"), plants.cast("int").alias("plants"), season.coarse_location(F.lit(12.34), F.lit(-7.5))["latitude"].alias("latitude"),
    )


# ---- identity: report, phases


@query(f"""WITH {catalog._RESOLVED}, k AS (SELECT r.*, CASE WHEN i.label = 'other' THEN 'unknown' ELSE i.label END AS lab, CASE WHEN final_status = 'review_needed_variety' THEN 'ocr' ELSE 'none' END AS stage FROM resolved r JOIN intake i USING (run_date, row_index) WHERE dropped IS NULL)
SELECT run_date, kind, value, count(*) AS n FROM (SELECT run_date, 'label' AS kind, lab AS value FROM k UNION ALL SELECT run_date, 'final_status', final_status FROM k UNION ALL SELECT run_date, 'review_stage', stage FROM k
 UNION ALL SELECT run_date, 'resolution_source', resolution_source FROM k) GROUP BY ALL""")
def run_counts(spark, sf_dir):
    return resolve.run_counts(catalog._resolved(spark, sf_dir)[0])


@query(f"""WITH {ad.INTAKE} SELECT run_date, row_index, 'sapling' AS lifecycle_stage, CASE WHEN run_date <= (SELECT min(run_date) + 6 FROM intake) THEN 'p1' END AS phase_id, CASE WHEN run_date = (SELECT min(run_date) FROM intake) THEN 'phase_start'
 WHEN run_date = (SELECT min(run_date) + 6 FROM intake) THEN 'phase_end' WHEN run_date < (SELECT min(run_date) + 6 FROM intake) THEN 'phase_window' END AS phase_boundary FROM intake""")
def phase_columns(spark, sf_dir):
    rows, _ = catalog._resolved(spark, sf_dir)
    first = ad.intake(spark, sf_dir).agg(F.min("run_date").alias("start_date"))
    phases = first.select(
        F.lit("p1").alias("phase_id"), F.lit("one").alias("phase_name"), F.lit("").alias("lifecycle_stage"), "start_date", F.date_add("start_date", 6).alias("end_date"),
        F.lit(None).cast("string").alias("start_label"), F.lit(None).cast("string").alias("end_label"), F.lit(1).alias("priority"),
    )
    return resolve.with_phases(rows, phases, "sapling").select("run_date", "row_index", "lifecycle_stage", "phase_id", "phase_boundary")


# ---- annotation


@query(f"""WITH {records._LINES} SELECT photo, count(*) AS boxes, 1.0 AS typed_ratio, count(*) FILTER (kind = 'pot') AS pots, count(*) FILTER (kind = 'varietal') AS varietals, count(*) FILTER (kind = 'other') AS others,
 count(DISTINCT value) FILTER (kind = 'pot') AS pot_ids, count(DISTINCT value) FILTER (kind = 'varietal') AS varietal_numbers FROM t GROUP BY photo""")
def box_typing(spark, sf_dir):
    return report.box_typing(boxes.typed(records._photos(spark, sf_dir), "photo"), "photo")


@query(f"WITH v AS ({oracle_sql()['box_pairing']}) SELECT count(DISTINCT photo) AS photos, count(*) AS rows, count(*) FILTER (needs_review) AS needs_review, count(*) FILTER (NOT needs_review) AS auto_resolved FROM v")
def pair_summary(spark, sf_dir):
    return report.pair_summary(catalog.box_pairing(spark, sf_dir), "photo")


@query(f"WITH v AS ({oracle_sql()['box_pairing']}) SELECT review_reason AS value, count(*) AS n FROM v WHERE review_reason <> '' GROUP BY 1")
def pair_reasons(spark, sf_dir):
    return report.pair_counts(catalog.box_pairing(spark, sf_dir), "review_reason")


@query(f"""WITH v AS ({oracle_sql()['box_pairing']}), b AS (SELECT l_orderkey AS photo, l_linenumber AS ord, l_returnflag = 'N' AS pot, l_suppkey % 12 + 1 AS c FROM lineitem),
e AS (SELECT photo, coalesce(list(DISTINCT c) FILTER (pot), []) AS s, coalesce(list(DISTINCT c) FILTER (NOT pot), []) AS k FROM b GROUP BY photo),
j AS (SELECT photo, o_custkey % 12 + 1 AS ps, o_custkey % 13 AS pk, s, k FROM e JOIN orders ON o_orderkey = photo),
w AS (SELECT v.*, p.c AS pc, q.c AS qc FROM v LEFT JOIN b p ON p.photo = v.photo AND p.ord = subject_ord AND p.pot LEFT JOIN b q ON q.photo = v.photo AND q.ord = class_ord AND NOT q.pot WHERE v.photo IN (SELECT photo FROM j)),
f AS (SELECT concat('conflict: pot ', pc, 'T expected ', pc, ' labeled ', qc) AS pattern FROM w WHERE review_reason = 'pot_varietal_conflict'
 UNION ALL SELECT concat('missing_varietal_for_pot: ', pc, 'T') FROM w WHERE review_reason = 'missing_varietal_pair' UNION ALL SELECT concat('orphan_varietal: ', qc) FROM w WHERE review_reason = 'orphan_varietal_without_pot'
 UNION ALL SELECT concat('pipeline_pot_not_in_manual_set: ', ps, 'T') FROM j WHERE NOT list_contains(s, ps) UNION ALL SELECT concat('pipeline_series_not_in_manual_set: ', pk) FROM j WHERE pk > 0 AND NOT list_contains(k, pk))
SELECT pattern, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10""")
def failure_patterns(spark, sf_dir):
    b = ad.photo_boxes(spark, sf_dir)
    subject = F.concat(F.col("class_number").cast("string"), F.lit("T"))
    pots = b.filter("kind = 'pot'").select("photo", F.col("ord").alias("subject_ord"), subject.alias("subject_id"), F.when(F.col("class_number") < 11, F.col("class_number")).alias("expected"))
    others = b.filter("kind <> 'pot'").select("photo", F.col("ord").alias("class_ord"), "class_number")
    pairs = catalog.box_pairing(spark, sf_dir).join(pots, ["photo", "subject_ord"], "left").join(others, ["photo", "class_ord"], "left")
    manual = boxes.evidence_sets(b.withColumn("value", F.when(F.col("kind") == "pot", subject).otherwise(F.col("class_number").cast("string"))), "photo")
    c = F.col("o_custkey")
    predicted = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("photo"), F.concat((c % 12 + 1).cast("string"), F.lit("T")).alias("subject_id"), (c % 13).alias("class_number"))
    return rank.top_patterns(report.failures(manual, predicted, pairs, "photo"), "pattern")


# boxes of 0.02 by 0.02 whose overlap reaches a half are nearer than 0.04, so that the distance alone suppresses
@query(f"""WITH RECURSIVE q AS (SELECT l_orderkey AS photo, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ord, l_linenumber % 4 AS m, l_suppkey % 12 + 1 AS cls, l_discount + 0.01 AS x, l_tax + 0.01 AS y FROM lineitem),
s AS (SELECT photo, min(ord) AS s, arg_min(x, ord) AS sx, arg_min(y, ord) AS sy, CASE WHEN cls <= 10 THEN cls END AS expected FROM q WHERE m = 1 GROUP BY photo, cls),
n AS (SELECT photo, cls, ord, x, y, row_number() OVER (PARTITION BY photo, cls ORDER BY ord) AS k FROM q WHERE m IN (0, 2)),
g AS (SELECT DISTINCT photo, cls, 0::BIGINT AS k, []::STRUCT(c BIGINT, x DOUBLE, y DOUBLE)[] AS m FROM n UNION ALL
 SELECT g.photo, g.cls, n.k, CASE WHEN len(list_filter(m, lambda a: sqrt(pow(a.x - n.x, 2) + pow(a.y - n.y, 2)) <= 0.04)) > 0 THEN m ELSE list_append(m, {{'c': n.ord, 'x': n.x, 'y': n.y}}) END FROM g JOIN n ON n.photo = g.photo AND n.cls = g.cls AND n.k = g.k + 1),
v AS (SELECT photo, cls AS class, unnest(max_by(m, k), recursive := true) FROM g GROUP BY photo, cls),
{catalog._PAIRS} SELECT *, review_reason <> '' AS needs_review, CAST(row_number() OVER (PARTITION BY photo ORDER BY subject_ord IS NULL, subject_ord, class_ord) AS INT) AS pair_index FROM r""")
def seed_resolution(spark, sf_dir):
    expected = spark.range(1, 11).select(F.concat(F.col("id").cast("string"), F.lit("T")).alias("subject_id"), F.col("id").alias("expected"))
    return boxes.resolved_seeds(boxes.typed(records._photos(spark, sf_dir), "photo"), "photo", expected)


_MANIFEST = """m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'pending' WHEN o_custkey % 4 > 0 THEN 'completed' ELSE 'started_empty' END AS annotation_status, o_orderkey % 7 = 0 AS mismatch,
 concat('r', CAST(o_custkey % 3 AS VARCHAR)) AS reviewer, concat('pot| ', o_orderstatus, '||') AS labels FROM orders)"""


def _manifest(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = boxes.annotation_status(F.when(k % 5 != 0, F.lit(2)), c % 4, k % 7 == 0)
    return ad.table(spark, sf_dir, "orders").select(
        "o_orderkey", a["status"].alias("annotation_status"), a["next_action"].alias("next_action"), (k % 7 == 0).alias("mismatch"), F.concat(F.lit("r"), (c % 3).cast("string")).alias("reviewer"),
        F.concat(F.lit("pot| "), F.col("o_orderstatus"), F.lit("||")).alias("labels"),
    )


@query(f"""WITH {_MANIFEST} SELECT o_orderkey, annotation_status, CASE WHEN mismatch THEN 'resolve_identity' WHEN annotation_status = 'completed' THEN 'review_for_masks' WHEN annotation_status = 'started_empty' THEN 'continue' ELSE 'start' END AS next_action FROM m""")
def annotation_status(spark, sf_dir):
    return _manifest(spark, sf_dir).select("o_orderkey", "annotation_status", "next_action")


@query(f"""WITH {_MANIFEST} SELECT count(*) AS expected, count(*) FILTER (annotation_status = 'completed') AS completed, count(*) FILTER (annotation_status = 'started_empty') AS started_empty,
 count(*) FILTER (annotation_status = 'pending') AS pending, count(*) FILTER (mismatch) AS mismatches FROM m""")
def annotation_summary(spark, sf_dir):
    return report.annotation_summary(_manifest(spark, sf_dir))


@query(f"WITH {_MANIFEST} SELECT 'reviewer' AS kind, reviewer AS value, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'label', trim(v), count(*) FROM (SELECT unnest(string_split(labels, '|')) AS v FROM m) WHERE trim(v) <> '' GROUP BY ALL")
def annotation_counts(spark, sf_dir):
    return report.annotation_counts(_manifest(spark, sf_dir))


@query(f"WITH i AS ({oracle_sql()['ingest_status']}) SELECT 'signal' AS kind, signal AS value, count(*) AS n FROM i GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM i GROUP BY ALL")
def queue_summary(spark, sf_dir):
    return report.queue_summary(records.ingest_status(spark, sf_dir), ("signal", "status"))


# ---- orders


@query("""WITH s AS (SELECT l_partkey AS part, l_linenumber AS n, l_orderkey AS o, l_suppkey AS u, ['risk', 'drift', 'info', 'warn', 'ok', 'else'][l_linenumber % 6 + 1] AS status FROM lineitem)
SELECT o, n, u, row_number() OVER (ORDER BY CASE status WHEN 'risk' THEN 0 WHEN 'drift' THEN 1 WHEN 'info' THEN 2 WHEN 'warn' THEN 3 WHEN 'ok' THEN 4 ELSE 99 END, -n, part, o, u) AS rank FROM s""")
def card_order(spark, sf_dir):
    names = F.array(*(F.lit(v) for v in ("risk", "drift", "info", "warn", "ok", "else")))
    rows = ad.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("u"), F.concat(F.col("l_partkey").cast("string"), F.lit("T")).alias("subject"), F.get(names, F.col("l_linenumber") % 6).alias("status")
    )
    order = rank.card_order(F.col("status"), F.col("n"), F.col("subject"))
    return rank.global_rank(rows, [*order, F.col("o"), F.col("u")]).select("o", "n", "u", F.col("rank").cast("long").alias("rank"))


@query(f"WITH i AS ({oracle_sql()['ingest_status']}) SELECT o_orderkey, row_number() OVER (PARTITION BY signal ORDER BY CASE status WHEN 'ready' THEN 0 WHEN 'missing_required_labels' THEN 1 WHEN 'identity_mismatch' THEN 2 WHEN 'missing_image' THEN 3"
       " WHEN 'missing_export' THEN 4 WHEN 'invalid_export' THEN 5 WHEN 'started_empty' THEN 6 ELSE 7 END, coalesce(CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 1000 END, 10000), o_orderkey) AS place FROM i")  # fmt: skip
def task_order(spark, sf_dir):
    k = F.col("o_orderkey")
    order = rank.task_order(F.col("status"), F.when(k % 6 != 0, k % 1000), F.lpad(k.cast("string"), 12, "0"))
    return rank.positions(records.ingest_status(spark, sf_dir), ["signal"], order, "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query(f"WITH i AS ({oracle_sql()['ingest_status']}) SELECT o_orderkey, row_number() OVER (ORDER BY CASE signal WHEN 'ocr_match' THEN 0 WHEN 'weak_ocr' THEN 1 ELSE 2 END, o_orderkey % 30, o_orderkey) AS place FROM i")
def reviewer_order(spark, sf_dir):
    order = rank.reviewer_order(F.col("signal"), F.col("o_orderkey") % 30, F.col("o_orderkey"))
    return rank.global_rank(records.ingest_status(spark, sf_dir), order, "place").select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, p_partkey) AS place FROM part WHERE p_size > 20")
def watchlist(spark, sf_dir):
    rows = ad.table(spark, sf_dir, "part").filter("p_size > 20")
    names = F.array(*(F.lit(v) for v in ("high", "medium", "low", "none")))
    order = rank.watchlist_order(F.get(names, F.col("p_size") % 4), F.concat(F.col("p_partkey").cast("string"), F.lit("T")))
    return rank.global_rank(rows, order, "place").select("p_partkey", F.col("place").cast("long").alias("place"))


# ---- pages and triage


@query(f"""WITH {ad.METRICS}, s AS (SELECT part, part % 7 AS variety, CASE WHEN coverage >= 0.055 THEN 'strong' WHEN coverage >= 0.05 THEN 'modest' ELSE 'stalled' END AS bucket FROM metrics)
SELECT (SELECT count(*) FROM s) AS subjects, (SELECT count(DISTINCT variety) FROM s) AS varieties, (SELECT count(*) FROM s WHERE bucket = 'strong') AS strong, (SELECT count(*) FROM s WHERE bucket <> 'strong') AS watch,
 (SELECT count(*) FROM s WHERE bucket = 'stalled') AS stalled, 'end' AS batch_label, count(*) AS metric_rows, count(CASE WHEN growth > 0 THEN 1 END) AS growth_rows, 31 AS days_between, 32 AS inclusive_days FROM metrics""")
def page_stats(spark, sf_dir):
    m = ad.metrics(spark, sf_dir)
    bucket = F.when(F.col("coverage") >= 0.055, "strong").when(F.col("coverage") >= 0.05, "modest").otherwise("stalled")
    s = m.select(F.col("part").alias("subject_id"), (F.col("part") % 7).alias("variety_name"), bucket.alias("bucket"), F.when(F.col("part") % 2 == 0, " end ").otherwise(" ").alias("batch_label"))
    return report.page_stats(s, m.select(F.col("part").alias("subject_id"), F.when(F.col("growth") > 0, F.col("growth")).alias("growth")), "2026-03-01", "2026-04-01")


@query(f"""WITH {ad.INTAKE} SELECT count(*) AS rows, count(DISTINCT user_id) AS subjects, count(DISTINCT run_date) AS dates, count(DISTINCT label) AS batches, count(DISTINCT row_index) AS row_indexes,
 NOT bool_or(label = 'other') AS all_rows_present, count(DISTINCT run_date) = 1 AND max(run_date) = DATE '2024-01-01' AS expected_end_matched FROM intake""")
def triage_summary(spark, sf_dir):
    rows = ad.intake(spark, sf_dir).select(F.col("user_id").cast("string").alias("subject_id"), F.col("run_date").alias("run_b_date"), F.col("label").alias("batch_id"), "row_index", F.when(F.col("label") == "other", " Yes").alias("missing"))
    return report.triage_summary(rows, "2024-01-01")


@query(f"""WITH {catalog._RESOLVED} SELECT i.run_date, i.row_index FROM intake i LEFT JOIN resolved r ON r.run_date = i.run_date AND r.row_index = i.row_index AND r.dropped IS NULL WHERE r.row_index IS NULL""")
def unmapped_rows(spark, sf_dir):
    rows, _ = catalog._resolved(spark, sf_dir)
    return merge.unmapped(ad.intake(spark, sf_dir).select("run_date", "row_index"), rows.filter("dropped IS NULL"), ["run_date", "row_index"])


# ---- exports, anchors and refreshes


_PHOTO_USE = """x AS (SELECT o_orderkey, 0 AS position, FALSE AS gone, CASE WHEN o_orderkey % 2 = 1 AND o_custkey % 4 = 0 THEN ' ' ELSE 'a' END AS asset, o_custkey % 7 = 0 AS undated, o_orderkey % 3 = 0 AS bare FROM orders
 UNION ALL SELECT o_orderkey, 1, o_custkey % 3 = 0, 'b', o_custkey % 7 = 0, FALSE FROM orders WHERE o_orderkey % 2 = 1),
u AS (SELECT o_orderkey AS path, position, CASE WHEN gone THEN 'excluded' WHEN trim(asset) = '' THEN 'no_asset' WHEN undated THEN 'no_date' WHEN bare THEN 'no_boxes' END AS skip FROM x)"""


def _photo_use(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    single, one = k % 2 == 0, F.array(F.struct(F.lit(0.5).alias("x")))
    found = F.when(k % 3 != 0, one).otherwise(F.array().cast("array<struct<x:double>>"))
    photo = lambda i, a, gone, b: F.struct(i.cast("long").alias("row_index"), a.alias("asset"), gone.alias("exclude_from_training"), b.alias("boxes"))
    photos = F.array(photo(F.lit(None), F.when(c % 4 == 0, " ").otherwise("a"), F.lit(None).cast("boolean"), found), photo(F.lit(7), F.lit("b"), c % 3 == 0, one))
    payloads = ad.table(spark, sf_dir, "orders").select(
        k.alias("path"), F.col("o_orderdate").alias("saved_at"), F.when(c % 7 != 0, F.to_date("o_orderdate")).alias("capture_date"), c.alias("row_index"), F.when(single, "a").alias("asset"),
        F.when(single, found).alias("boxes"), F.when(~single, photos).alias("photos"),
    )
    return boxes.usability(boxes.photo_rows(payloads))


@query(f"WITH {_PHOTO_USE} SELECT path, CAST(position AS INT) AS position, skip FROM u")
def photo_use(spark, sf_dir):
    return _photo_use(spark, sf_dir).select("path", "position", "skip")


@query(f"WITH {_PHOTO_USE} SELECT count(*) AS total, count(*) FILTER (skip IS NULL) AS processed, count(skip) AS skipped, count(*) FILTER (skip = 'excluded') AS excluded FROM u")
def photo_use_counts(spark, sf_dir):
    return boxes.usability_counts(_photo_use(spark, sf_dir))


@query(f"""WITH {ad.INTAKE}, o AS (SELECT run_date, event_id % 4 <> 1 AS seen, event_id % 32 AS s FROM intake WHERE event_id % 50 = 7 AND (run_date <> {_LAST} OR event_id % 3 = 0))
SELECT run_date, count(*) AS rows, count(*) FILTER (seen) AS reviewed_rows, count(DISTINCT s) FILTER (seen) AS subjects FROM o GROUP BY run_date""")
def anchor_runs(spark, sf_dir):
    rows = ad.intake(spark, sf_dir)
    return quality.anchor_runs(ad.overrides(rows), select.of_run(rows).filter("event_id % 3 = 0"))


@query(f"""WITH {ad.INTAKE}, o AS (SELECT * FROM intake WHERE event_id % 50 = 7 AND run_date = (SELECT run_date FROM intake WHERE row_index = 108))
SELECT coalesce(bool_or(event_id % 100 = 7 AND event_id % 30 = 17), FALSE) AS declared_missing, coalesce(bool_or(event_id % 4 <> 1 AND event_id % 32 = 17), FALSE) AS has_row,
 coalesce(bool_or(row_index = 108), FALSE) AS excluded_row, coalesce(bool_or(row_index = 58), FALSE) AS chosen_row FROM o""")
def anchor_marks(spark, sf_dir):
    rows = ad.intake(spark, sf_dir)
    run = rows.filter("row_index = 108").agg(F.max("run_date")).first()[0]
    return quality.anchor_marks(ad.overrides(rows), run, "18T", 108, 58, "checked")


@query("""WITH b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 5 = 0) SELECT 'batch_size' AS code, CAST(count(*) AS VARCHAR) AS item FROM b HAVING count(*) <> 7
UNION ALL SELECT 'missing_in_batch', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM b)""")
def refresh_problems(spark, sf_dir):
    batch = ad.table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return merge.refresh_problems(ad.table(spark, sf_dir, "customer"), batch, "c_custkey", 7)


@query(f"WITH r AS ({oracle_sql()['run_cards']}) SELECT run_date, CASE WHEN rows % 2 = 0 THEN 'census' ELSE 'mixed' END AS mode FROM r")
def batch_modes(spark, sf_dir):
    cards = reviews.run_cards(spark, sf_dir)
    return cards.select("run_date", scores.batch_mode(F.col("rows"), F.col("rows") - F.col("rows") % 2).alias("mode"))
