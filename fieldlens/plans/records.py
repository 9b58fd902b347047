"""Registered queries for history, annotation, audits, gates, merges of records and seasons, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import boxes, intervals, lookup, merge, nearest, quality, rank, report, resolve, season, similarity
from ..sources import tables
from ..sources.shared import stored
from . import adapters as ad
from . import catalog
from .registry import oracle_sql, query

# ---- identity resolution with names from rows and from history

_KNOWN = """src AS (SELECT event_id, event_id + 1 AS row_index, CAST(ts AS DATE) AS run_date, user_id % 40 AS n, event_type, CASE WHEN event_id % 4 = 0 THEN concat('Kind ', CAST(user_id % 7 AS VARCHAR)) END AS derived FROM events),
pos AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY row_index) AS p, n > 0 AND (event_id % 3 <> 0 OR event_id % 5 = 0) AS found FROM src),
sub AS (SELECT *, CASE WHEN found THEN n ELSE p END AS s FROM pos WHERE found OR p <= 32),
k AS (SELECT n, run_date, max_by(derived, row_index) AS v, max(row_index) AS r FROM src WHERE event_type = 'view' AND event_id % 5 = 0 AND derived IS NOT NULL GROUP BY ALL),
h AS (SELECT w.s, w.run_date, max_by(k.v, k.r) AS v FROM (SELECT DISTINCT s, run_date FROM sub) w JOIN k ON k.n = w.s AND k.run_date < w.run_date GROUP BY ALL)"""


@query(f"""WITH {_KNOWN} SELECT run_date, row_index, concat(CAST(s AS VARCHAR), 'T') AS subject_id, coalesce(derived, v) AS variety_name,
 CASE WHEN coalesce(derived, v) IS NULL THEN 'manual_review' WHEN coalesce(derived, v) = v THEN 'historical_continuity' WHEN NOT found THEN 'sequence_inference' ELSE 'direct_detection' END AS resolution_source
 FROM sub LEFT JOIN h USING (s, run_date)""")
def historical_names(spark, sf_dir):
    rows = ad.intake(spark, sf_dir).withColumns(
        {
            "caption": F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("tomato "), (F.col("user_id") % 40).cast("string"))).otherwise(""),
            "variety_name": F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Kind "), (F.col("user_id") % 7).cast("string"))),
        }
    )
    dims = [d.filter("false") for d in ad.dims(spark, sf_dir)]
    out = resolve.resolve_identities(rows, *dims, ad.overrides(rows).filter("false"), resolve.Params(name_fallback=True))
    return out.filter("dropped IS NULL").select("run_date", "row_index", "subject_id", "variety_name", "resolution_source")


# ---- annotation payloads

_LINES = """b AS (SELECT l_orderkey AS photo, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ord, l_linenumber % 4 AS m, l_suppkey % 12 + 1 AS c FROM lineitem),
t AS (SELECT photo, ord, CASE m WHEN 1 THEN 'pot' WHEN 3 THEN 'other' ELSE 'varietal' END AS kind,
  CASE m WHEN 1 THEN concat(CAST(c AS VARCHAR), 'T') WHEN 3 THEN NULL ELSE CAST(c AS VARCHAR) END AS value FROM b)"""


def _photos(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem")
    c, m = (F.col("l_suppkey") % 12 + 1).cast("string"), F.col("l_linenumber") % 4
    says = (
        F.when(m == 0, F.concat(F.lit("Varietal No "), c)).when(m == 1, F.concat(F.lit("Pot 0"), c, F.lit(" T")))
        .when(m == 2, F.concat(c, F.lit(" varietal tag"))).otherwise("leaf")
    )
    box = F.struct("l_linenumber", "l_partkey", "l_suppkey", says.alias("description"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.lit(0.02).alias("w"), F.lit(0.02).alias("h"))
    return li.groupBy(F.col("l_orderkey").alias("photo")).agg(F.array_sort(F.collect_list(box)).alias("boxes"))


@query(f"WITH {_LINES} SELECT photo, CAST(ord AS INT) AS ord, kind, value FROM t")
def annotation_kinds(spark, sf_dir):
    return boxes.typed(_photos(spark, sf_dir), "photo").select("photo", "ord", "kind", "value")


@query(f"WITH {_LINES}, d AS (SELECT photo, CASE m WHEN 0 THEN concat('Varietal No ', CAST(c AS VARCHAR)) WHEN 1 THEN concat('Pot 0', CAST(c AS VARCHAR), ' T') WHEN 2 THEN concat(CAST(c AS VARCHAR), ' varietal tag') ELSE 'leaf' END AS x FROM b)"
       " SELECT photo, string_agg(DISTINCT x, '|' ORDER BY x) AS labels, CAST(count(*) AS INT) AS boxes FROM d GROUP BY photo")  # fmt: skip
def label_sets(spark, sf_dir):
    return boxes.label_sets(_photos(spark, sf_dir), "photo").select("photo", F.array_join("labels", "|").alias("labels"), "boxes")


@query(f"""WITH {_LINES}, e AS (SELECT photo, coalesce(list(DISTINCT value) FILTER (kind = 'pot'), []) AS s, coalesce(list(DISTINCT value) FILTER (kind = 'varietal'), []) AS c FROM t GROUP BY photo),
j AS (SELECT list_contains(s, concat(CAST(o_custkey % 12 + 1 AS VARCHAR), 'T')) AS hs, list_contains(c, CAST(o_custkey % 12 AS VARCHAR)) AS hc, len(s) = 1 AND len(c) = 1 AS strict,
  EXISTS (SELECT 1 FROM t a JOIN t b USING (photo) WHERE a.photo = o_orderkey AND a.kind = 'pot' AND b.kind = 'varietal' AND b.ord = a.ord + 1 AND a.value = concat(CAST(o_custkey % 12 + 1 AS VARCHAR), 'T') AND b.value = CAST(o_custkey % 12 AS VARCHAR)) AS ex
  FROM e JOIN orders ON photo = o_orderkey)
SELECT count(*) AS joined, round(avg(CAST(hs AS INT)), 9) AS subject_rate, round(avg(CAST(hc AS INT)), 9) AS class_rate, round(avg(CAST(hs AND hc AS INT)), 9) AS both_rate, round(avg(CAST(ex AS INT)), 9) AS exact_rate,
 count(*) FILTER (strict) AS strict_rows, count(*) FILTER (strict AND hs AND hc) AS strict_right FROM j""")
def presence_audit(spark, sf_dir):
    # a pot's box and the class box after it are a pair
    found = stored(boxes.evidence(boxes.typed(_photos(spark, sf_dir), "photo").select("photo", "ord", "kind", "value"), "photo"), "photo-evidence")
    manual, pairs = found.drop("pairs"), found.select("photo", F.inline("pairs"))
    o = F.col("o_custkey") % 12
    predicted = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("photo"), F.concat((o + 1).cast("string"), F.lit("T")).alias("subject_id"), o.alias("class_number"))
    rates = ("subject_rate", "class_rate", "both_rate", "exact_rate")
    return report.presence_audit(manual, predicted, pairs, "photo").withColumns({c: F.round(c, 9) for c in rates})


@query("""WITH p AS (SELECT *, CAST(o_orderdate AS DATE) AS d, concat('f', lpad(CAST(o_orderkey AS VARCHAR), 9, '0')) AS path FROM orders),
x AS (SELECT path, o_orderdate AS saved_at, d, o_custkey AS row_index, concat('a', CAST(o_custkey % 5 AS VARCHAR)) AS asset, 0 AS position FROM p WHERE o_orderkey % 2 = 0
 UNION ALL SELECT path, o_orderdate, d, 1, concat('a', CAST(o_custkey % 5 AS VARCHAR)), 0 FROM p WHERE o_orderkey % 2 = 1
 UNION ALL SELECT path, o_orderdate, d, 7, 'b', 1 FROM p WHERE o_orderkey % 2 = 1 AND o_custkey % 3 <> 0)
SELECT d AS capture_date, row_index, asset, path, CAST(position AS INT) AS position FROM x QUALIFY row_number() OVER (PARTITION BY d, row_index, asset ORDER BY saved_at DESC, path, position) = 1""")
def latest_seeds(spark, sf_dir):
    o, box = ad.table(spark, sf_dir, "orders"), "array<struct<x:double>>"
    asset, odd = F.concat(F.lit("a"), (F.col("o_custkey") % 5).cast("string")), F.col("o_orderkey") % 2 == 1
    photo = lambda i, a, gone: F.struct(i.cast("long").alias("row_index"), a.alias("asset"), gone.alias("exclude_from_training"), F.array().cast(box).alias("boxes"))
    photos = F.array(photo(F.lit(None), asset, F.lit(None).cast("boolean")), photo(F.lit(7), F.lit("b"), F.col("o_custkey") % 3 == 0))
    payloads = o.select(
        F.concat(F.lit("f"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"), F.lit("v").alias("version"), F.col("o_orderdate").alias("saved_at"), F.to_date("o_orderdate").alias("capture_date"),
        F.when(~odd, F.col("o_custkey")).alias("row_index"), F.when(~odd, asset).alias("asset"), F.when(~odd, F.array().cast(box)).alias("boxes"), F.when(odd, photos).alias("photos"),
    )
    return boxes.latest_seeds(boxes.expanded(payloads)).select("capture_date", "row_index", "asset", "path", "position")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 3 = 0 THEN 'started_empty' WHEN o_custkey % 2 = 0 THEN 'missing_export' WHEN o_custkey % 5 = 0 THEN 'invalid_export'
 WHEN o_orderkey % 5 = 0 THEN 'identity_mismatch' WHEN o_orderstatus <> 'F' THEN 'missing_required_labels' WHEN o_custkey % 7 = 0 THEN 'missing_image' ELSE 'ready' END AS status,
 CASE WHEN o_orderkey % 4 = 0 THEN 'ocr_match' WHEN o_orderkey % 4 = 1 THEN 'weak_ocr' ELSE 'no_signal' END AS signal FROM orders""")
def ingest_status(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = boxes.ingest_status(k % 3, F.when(c % 2 != 0, F.lit("x")), c % 5 != 0, k % 5 == 0, F.array("o_orderstatus", F.lit("pot")), ["F", "pot"], c % 7 != 0)
    signal = scores.signal_tier(F.when(k % 4 == 0, 1).otherwise(0), F.when(k % 4 < 2, 1).otherwise(0))
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), signal.alias("signal"))


@query("""SELECT concat('k', CAST(l_orderkey AS VARCHAR)) AS task_key, l_linenumber AS ord, printf('%d %.6f %.6f %.6f %.6f', CASE l_returnflag WHEN 'N' THEN 1 ELSE 0 END, l_discount + 0.01, l_tax + 0.02, 0.02, 0.04) AS value
 FROM lineitem WHERE l_returnflag IN ('A', 'N')""")
def training_lines(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("task_key"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("label"),
        F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.lit(0.02).alias("w"), F.lit(0.04).alias("h"),
    )
    return tables.yolo_lines(li, ["A", "N"])


@query("""SELECT o_orderkey AS k, 1 AS photo_index, concat('a', CAST(o_orderkey AS VARCHAR)) AS asset, 640 AS width, o_orderkey * 1000 AS captured_ms FROM orders
 UNION ALL SELECT o_orderkey, 2, concat('b', CAST(o_orderkey AS VARCHAR)), NULL, NULL FROM orders""")
def album_rows(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    raw = F.concat(F.lit('[["a'), k, F.lit('","u","640","480","'), k, F.lit('000","0"],["b'), k, F.lit('"]]'))
    payload = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), raw.alias("raw"))
    return tables.flattened_album(payload, "raw").select("k", "photo_index", "asset", "width", "captured_ms")


# ---- order and scores

_READY = "CASE WHEN focus >= 0.70 AND inner_spill <= 0.16 AND coverage >= 0.012 THEN 'high' WHEN focus >= 0.46 AND inner_spill <= 0.38 AND coverage >= 0.006 THEN 'moderate' WHEN focus >= 0.36 THEN 'moderate' ELSE 'low' END"


@query(f"""WITH {ad.METRICS}, r AS (SELECT part, {_READY} AS readiness, round(focus, 9) AS f, round(inner_spill, 9) AS s, round(coverage, 9) AS c FROM metrics)
SELECT part, readiness, row_number() OVER (ORDER BY CASE readiness WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, f DESC, s, c DESC, part) AS rank FROM r""")
def label_queue(spark, sf_dir):
    m = ad.metrics(spark, sf_dir).withColumn("readiness", scores.readiness(F.col("focus"), F.col("inner_spill"), F.col("coverage"), F.col("growth")))
    near = lambda c: F.round(c, 9)
    order = rank.label_queue_order(F.col("readiness"), near("focus"), near("inner_spill"), near("neighbor_spill"), near("coverage"), F.col("part"), F.col("part").cast("string"))
    return rank.global_rank(m, order).select("part", "readiness", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {ad.METRICS}, r AS (SELECT part, round(0.70 * neighbor_spill + 0.15 * (1 - focus) + 0.05 * least(greatest(coverage, 0), 0.08) / 0.08 + CASE {_READY} WHEN 'low' THEN 0.10 WHEN 'moderate' THEN 0.05 ELSE 0 END, 9) AS severity FROM metrics)
SELECT part, severity, row_number() OVER (ORDER BY severity DESC, part) AS rank FROM r QUALIFY rank <= 12""")
def severity_ranking(spark, sf_dir):
    ready = scores.readiness(F.col("focus"), F.col("inner_spill"), F.col("coverage"), F.col("growth"))
    s = F.round(scores.severity(F.col("neighbor_spill"), F.col("focus"), F.col("coverage"), ready), 9)
    return rank.top_k(ad.metrics(spark, sf_dir).select("part", s.alias("severity")), [-F.col("severity"), F.col("part")], 12)


@query(f"""WITH {ad.METRICS} SELECT part, round(least(greatest(45 * least(coverage / 0.10, 1) + 20 * least(greatest(growth + 0.25, 0), 1) + 20 * (1 - least(chlorosis / 0.45, 1)) + 10 * greatest(0, 1 - abs(plants - 2) / 3)
  + 5 * (CASE WHEN brightness < 45 OR brightness > 225 THEN 0.6 ELSE 1 END) * (CASE WHEN blur < 120 THEN 0.7 ELSE 1 END), 0), 100), 2) AS health,
 CASE WHEN blur < 120 THEN 'retake_photo' WHEN plants >= 3 AND coverage > 0.055 THEN 'thin_seedlings' WHEN chlorosis >= 0.30 THEN 'check_nutrients' WHEN growth < -0.20 THEN 'check_roots' WHEN coverage < 0.02 THEN 'increase_light' ELSE 'maintain' END AS action,
 round(least(greatest(0.5 * (1 - neighbor_spill) + 0.35 * focus + 0.10 * (1 - least(inner_spill, 1)) + 0.05 * coverage, 0), 1), 9) AS focus_score FROM metrics""")
def early_scores(spark, sf_dir):
    c = {n: F.col(n) for n in ("coverage", "growth", "chlorosis", "plants", "brightness", "blur", "focus", "inner_spill", "neighbor_spill")}
    return ad.metrics(spark, sf_dir).select(
        "part", scores.health_v1(c["coverage"], c["growth"], c["chlorosis"], c["plants"], c["brightness"], c["blur"]).alias("health"),
        scores.action(c["blur"], c["plants"], c["coverage"], c["chlorosis"], c["growth"]).alias("action"),
        F.round(scores.focus_score(c["neighbor_spill"], c["focus"], c["inner_spill"], c["coverage"]), 9).alias("focus_score"),
    )


@query("SELECT user_id, max(ts) AS latest, count(*) AS exports FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def export_counts(spark, sf_dir):
    return rank.export_counts(ad.table(spark, sf_dir, "events"), "user_id", "ts")


# ---- audits and gates


@query(f"""WITH {ad.INTAKE} SELECT run_date, count(*) AS rows, count(*) FILTER (event_id % 4 <> 1) AS reviewed_rows, count(*) FILTER (event_id % 20 <> event_id % 10) AS changed_rows FROM intake WHERE event_id % 50 = 7 GROUP BY run_date""")
def override_summary(spark, sf_dir):
    rows = ad.intake(spark, sf_dir).filter("event_id % 50 = 7")
    return report.override_summary(rows.select("run_date", (F.col("event_id") % 20).alias("confirmed"), (F.col("event_id") % 10).alias("suggested"), (F.col("event_id") % 4 != 1).alias("reviewed")))


@query(f"""WITH {ad.INTAKE} SELECT count(*) AS rows, count(DISTINCT user_id) AS species, min(run_date) AS first_run, max(run_date) AS last_run, round(100 * avg(CASE WHEN label <> 'other' THEN 1 ELSE 0 END), 2) AS completion FROM intake""")
def catalog_completion(spark, sf_dir):
    rows = ad.intake(spark, sf_dir).withColumns({"species": F.col("user_id"), "label": F.when(F.col("label") == "other", "unknown").otherwise(F.col("label"))})
    return report.catalog_completion(rows)


@query("SELECT concat(CAST(user_id % 40 AS VARCHAR), 'T') AS subject_id, count(*) AS n FROM events WHERE event_id % 4 IN (0, 2) AND user_id % 40 > 0 GROUP BY 1")
def message_subjects(spark, sf_dir):
    k, n = F.col("event_id") % 4, (F.col("user_id") % 40).cast("string")
    said = F.when(k == 0, F.concat(F.lit("row 3: pot 0"), n, F.lit("t: moved"))).when(k == 1, F.concat(F.lit("lot "), n, F.lit("T arrived"))).when(k == 2, F.concat(F.lit("Pot  "), n, F.lit("T has no name"))).otherwise(F.concat(F.lit("spot "), n, F.lit("T")))
    return report.subjects_in_messages(ad.table(spark, sf_dir, "events").select(said.alias("said")), "said")


@query(f"""WITH {catalog._PROFILE}, m AS (SELECT *, CASE WHEN caption_rate >= 0.1 THEN 'baseline' ELSE 'random' END AS mode FROM prof)
SELECT max(run_date) AS latest_run, max(run_date) FILTER (mode = 'baseline') AS baseline_run, round(max_by(1 - non_unknown_rate, run_date), 9) AS unknown_latest,
 round(max_by(1 - non_unknown_rate, run_date) FILTER (mode = 'baseline'), 9) AS unknown_baseline, count(*) FILTER (mode = 'random') AS random_runs FROM m""")
def run_drift(spark, sf_dir):
    p = catalog.batch_profile(spark, sf_dir).withColumn("mode", F.when(F.col("caption_rate") >= 0.1, "baseline").otherwise("random"))
    return report.drift(p).withColumns({c: F.round(c, 9) for c in ("unknown_latest", "unknown_baseline")})


@query("""WITH p AS (SELECT o_custkey AS phase_id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) AS e, o_orderkey % 97 AS priority, o_orderkey AS k FROM orders),
d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT day, min_by(k, struct_pack(a := priority, b := k)) AS span FROM d JOIN p ON day BETWEEN s AND e GROUP BY day""")
def order_spans(spark, sf_dir):
    day = F.to_date("o_orderdate")
    spans = ad.table(spark, sf_dir, "orders").select(day.alias("s"), F.date_add(day, (F.col("o_orderkey") % 60).cast("int")).alias("e"), (F.col("o_orderkey") % 97).alias("priority"), F.col("o_orderkey").alias("k"))
    days = ad.table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return intervals.first_holding(days, "day", spans, "s", "e", ["priority", "k"], ["k"]).select("day", F.col("found.k").alias("span"))


@query("""WITH phases(phase_id, s, e, x) AS (VALUES ('p1', DATE '1995-01-01', DATE '1995-12-31', FALSE), ('p2', DATE '1995-06-15', DATE '1996-06-30', FALSE), ('p3', DATE '1996-05-01', DATE '1996-12-31', TRUE),
 ('p4', DATE '1996-12-31', NULL, FALSE), ('p5', DATE '2030-01-01', DATE '2030-02-01', FALSE), ('p6', DATE '2030-01-15', DATE '2031-01-01', FALSE)),
n AS (SELECT *, lead(s) OVER (ORDER BY s) AS nxt FROM phases), l AS (SELECT phase_id, max(CAST(o_orderdate AS DATE)) AS d FROM n JOIN orders ON CAST(o_orderdate AS DATE) >= s AND CAST(o_orderdate AS DATE) < nxt GROUP BY phase_id),
j AS (SELECT n.*, d, CASE WHEN e IS NULL THEN 'missing_phase_end' WHEN nxt IS NULL OR nxt > e THEN 'timeline_end' WHEN x THEN 'explicit_end_batch' WHEN d IS NULL THEN 'no_run_before_next' ELSE 'latest_run_before_next' END AS basis FROM n LEFT JOIN l USING (phase_id))
SELECT phase_id, CASE WHEN basis = 'latest_run_before_next' THEN d ELSE e END AS effective_end, basis FROM j""")
def effective_ends(spark, sf_dir):
    rows = [
        ("p1", "1995-01-01", "1995-12-31", 1, False), ("p2", "1995-06-15", "1996-06-30", 2, False), ("p3", "1996-05-01", "1996-12-31", 3, True),
        ("p4", "1996-12-31", None, 4, False), ("p5", "2030-01-01", "2030-02-01", 5, False), ("p6", "2030-01-15", "2031-01-01", 6, False),
    ]
    phases = spark.createDataFrame(rows, "phase_id string, start_date string, end_date string, priority int, explicit_end boolean").withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})
    return quality.effective_end(phases, ad.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("run_date")))


@query(f"""WITH {ad.INTAKE} SELECT row_index, CASE WHEN caption = '' THEN 'too_few_parts' WHEN user_id % 40 > 24 THEN 'unknown_variety' END AS reject FROM intake""")
def caption_checks(spark, sf_dir):
    n = ad.table(spark, sf_dir, "nation")
    known = lookup.keys_of_registry(n.select(F.concat(F.lit("plant_"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("row_index")))
    return quality.checked(ad.intake(spark, sf_dir), "caption", known).select("row_index", "reject")


@query("SELECT 'count_differs' AS code, concat(i, '=', CAST(n AS VARCHAR)) AS item FROM (SELECT 'customers' AS i, count(DISTINCT o_custkey) AS n, 1 AS w FROM orders UNION ALL SELECT 'orders', count(*), 0 FROM orders) WHERE n <> w")
def anchor_checks(spark, sf_dir):
    counts = ad.table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("orders"))
    return quality.anchors(counts, {"customers": 1, "orders": 0})


# ---- merges of records


@query("""SELECT o_orderkey AS k, concat('a', CAST(o_custkey AS VARCHAR)) AS asset, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 AND o_orderkey % 3 <> 0 THEN 'new' ELSE o_orderpriority END AS label,
 o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 AS applied, o_orderkey % 8 = 0 AS mismatch FROM orders""")
def guarded_overlay(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("asset"), F.col("o_orderpriority").alias("label"))
    other = F.when(F.col("k") % 8 == 0, F.lit("z")).when(F.col("k") % 5 == 0, F.lit("")).otherwise(F.col("asset"))
    over = o.filter("k % 4 = 0").select("k", other.alias("asset"), F.when(F.col("k") % 3 != 0, "new").otherwise("").alias("label"))
    return lookup.overlay(o, over, "k", "asset", ["label"]).select("k", "asset", "label", "applied", "mismatch")


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN 'review' WHEN o_orderkey % 6 = 0 THEN 'queue' ELSE o_orderpriority END AS url FROM orders WHERE o_orderkey % 2 = 0""")
def review_backfill(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("url"))
    review = o.filter("k % 2 = 0").withColumn("url", F.when(F.col("k") % 4 != 0, "review"))
    return merge.backfilled(o.filter("k % 6 = 0").withColumn("url", F.lit("queue")), review, o, ["k"], "url")


@query("SELECT o_orderkey AS k, TRUE AS exclude_row FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > (SELECT 0.99 * max(o_totalprice) FROM orders))")
def pre_boundary_rows(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    top = o.agg((0.99 * F.max("o_totalprice")).alias("t"))
    return merge.pre_boundary(o.select("k"), o.join(F.broadcast(top), F.col("o_totalprice") > F.col("t")), "k")


@query("SELECT c_custkey, CASE WHEN n IS NULL THEN c_mktsegment ELSE 'batch' END AS c_mktsegment, coalesce(n, c_nationkey) AS c_nationkey FROM customer LEFT JOIN (SELECT o_custkey, CAST(count(*) AS INT) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) ON o_custkey = c_custkey")
def triage_refresh(spark, sf_dir):
    batch = ad.table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit("batch").alias("c_mktsegment"), F.count("*").cast("int").alias("c_nationkey"))
    return merge.refreshed(ad.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), batch, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query(f"""WITH {ad.INTAKE} SELECT row_index, CASE WHEN user_id % 2 = 0 AND event_id % 4 <> 0 THEN 'Bean' WHEN caption <> '' AND user_id % 3 = 0 THEN 'tomato' WHEN caption <> '' THEN concat('Plant ', CAST(user_id % 40 AS VARCHAR)) END AS name,
 CASE WHEN event_id % 2 = 0 THEN run_date ELSE DATE '2024-05-06' END AS capture_date FROM intake""")
def derived_names(spark, sf_dir):
    e = F.col("event_id")
    name = text.variety_name(F.when(F.col("user_id") % 2 == 0, F.when(e % 4 != 0, " Bean ").otherwise("Unknown")), F.lit("tomato"), F.when((F.col("caption") != "") & (F.col("user_id") % 3 == 0), "tomato | p").otherwise(F.col("caption")))
    day = text.capture_date(F.lit(" "), F.when(e % 2 == 0, F.concat(F.col("run_date").cast("string"), F.lit("T23:59:59-08:00"))), F.lit("2024-05-06 01:02:03"))
    return ad.intake(spark, sf_dir).select("row_index", name.alias("name"), day.alias("capture_date"))


# ---- vectors


@query("""WITH t AS (SELECT vec_id AS near_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT near_id, v, sqrt(list_dot_product(v, v)) AS n FROM t),
s AS (SELECT q.near_id AS vec_id, u.near_id, round(list_dot_product(q.v, u.v) / q.n / u.n, 9) AS score FROM u q, u WHERE q.near_id % 50 = 0)
SELECT vec_id, near_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, near_id) AS rank FROM s QUALIFY rank <= 5""")
def nearest_vectors(spark, sf_dir):
    e = ad.table(spark, sf_dir, "embeddings")
    known = e.select(F.col("vec_id").alias("near_id"), similarity.unit(F.col("embedding")).alias("template"))
    return nearest.nearest(e.filter("vec_id % 50 = 0"), "embedding", known, "near_id", "vec_id", k=5).select("vec_id", "near_id", "rank")


@query(f"""WITH found AS ({oracle_sql()["template_matches"]}), j AS (SELECT vec_id, max(CASE WHEN f.rank = 1 AND f.label = e.label THEN 1 ELSE 0 END) AS a, max(CASE WHEN f.label = e.label THEN 1 ELSE 0 END) AS b
 FROM found f JOIN embeddings e USING (vec_id) GROUP BY vec_id) SELECT count(*) AS rows, round(avg(a), 4) AS top1, round(avg(b), 4) AS top3 FROM j""")
def match_accuracy(spark, sf_dir):
    return similarity.accuracy(catalog.template_matches(spark, sf_dir), ad.table(spark, sf_dir, "embeddings"), "vec_id", "label")


# ---- season

_VARIETY = "concat('v', CAST(l_suppkey % 12 AS VARCHAR))"


def _sessions(spark, sf_dir):
    entry = F.struct(
        F.concat(F.lit("v"), (F.col("l_suppkey") % 12).cast("string")).alias("variety"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")).alias("rating"),
        F.array("l_returnflag", "l_linestatus").alias("tags"), (F.col("l_discount") > 0.05).alias("grow_again"),
    )
    return ad.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("taster")).agg(F.collect_list(entry).alias("varieties"))


@query(f"""SELECT {_VARIETY} AS variety, count(*) AS tastings, round(avg(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END), 9) AS mean_rating, round(avg(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END), 9) AS grow_again_share,
 round(avg(CASE WHEN l_linenumber % 3 <> 0 THEN 1 ELSE 0 END), 9) AS filled_share FROM lineitem GROUP BY 1""")
def tasting_rollup(spark, sf_dir):
    return season.tasting(_sessions(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("mean_rating", "grow_again_share", "filled_share")})


@query(f"WITH t AS (SELECT {_VARIETY} AS variety, unnest([l_returnflag, l_linestatus]) AS tag FROM lineitem) SELECT variety, tag, count(*) AS n FROM t GROUP BY ALL")
def tasting_tags(spark, sf_dir):
    return season.tag_counts(_sessions(spark, sf_dir))


@query("SELECT count(*) FILTER (p_size * 2 >= 65) AS good, count(*) FILTER (p_size * 2 >= 80) AS excellent, count(*) FILTER (p_size * 2 >= 65) >= 3 AND count(*) FILTER (p_size * 2 >= 80) >= 1 AS success FROM part")
def season_success(spark, sf_dir):
    return season.success(ad.table(spark, sf_dir, "part").select((F.col("p_size") * 2).alias("score")))
