"""Registered queries for reviews, tags, run cards and hard rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import lookup, merge, rank, report, review, similarity
from . import adapters as ad
from . import catalog, records
from .registry import oracle_sql, query

# ---- reviews of hard cases


def _cases(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = ad.table(spark, sf_dir, "orders").withColumns({"run_date": F.to_date("o_orderdate"), "row_index": k, "asset": F.concat(F.lit("a"), c.cast("string"))})
    nation = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("_n"), "n_name")
    named = o.withColumn("_n", c % 25).join(nation, "_n").withColumnRenamed("n_name", "by_customer").drop("_n")
    named = named.withColumn("_n", k % 25).join(nation, "_n").withColumnRenamed("n_name", "by_order").drop("_n")
    blank = lambda cond, v: F.when(cond, v).otherwise("")
    said = named.filter("o_orderkey % 3 <> 0").select(
        *review.KEYS, blank(k % 10 != 0, "r").alias("photo_url"), blank(k % 4 != 0, F.concat(F.lit(" 0"), (c % 40).cast("string"), F.lit("t"))).alias("suggested_subject"),
        blank(k % 5 == 0, F.concat((c % 12 + 1).cast("string"), F.lit("T"))).alias("confirmed_subject"), blank(k % 7 == 0, F.lower("by_customer")).alias("suggested_name"),
        blank(k % 7 == 3, F.col("by_order")).alias("confirmed_name"), F.when(k % 13 == 0, " Reject").when(k % 17 == 0, "fine").alias("verdict"),
        F.when(k % 19 == 0, "Yes").alias("do_not_use"), F.when(k % 6 == 2, "in a pot; keep_suggested_varietal=1").when(k % 8 == 0, "varietal_lock=1").otherwise("").alias("notes"),
    )
    queue = named.filter("o_orderkey % 2 = 0").select(
        *review.KEYS, blank(k % 4 == 0, "q").alias("photo_url"), F.concat((c % 20).cast("string"), F.lit("T")).alias("subject_id"), blank(k % 11 == 0, F.col("by_customer")).alias("variety_name")
    )
    series, fixed, _ = ad.dims(spark, sf_dir)
    return review.canonical_reviews(said, queue, o.select(*review.KEYS, F.lit("l").alias("photo_url")), series, fixed)


_CASES = """o AS (SELECT CAST(o_orderdate AS DATE) AS run_date, o_orderkey AS k, o_custkey AS c, o_orderkey % 3 <> 0 AS r FROM orders WHERE o_orderkey % 2 = 0),
s AS (SELECT *, nullif(CASE WHEN r AND k % 4 <> 0 THEN c % 40 ELSE c % 20 END, 0) AS sid, CASE WHEN r AND k % 5 = 0 THEN c % 12 + 1 END AS given, CASE WHEN (r AND k % 7 = 0) OR k % 11 = 0 THEN c % 25 + 1 END AS sn,
  CASE WHEN r AND k % 7 = 3 THEN k % 25 + 1 END AS cn, r AND k % 6 = 2 AS keep_s, r AND k % 6 <> 2 AND k % 8 = 0 AS keep_c, r AND (k % 13 = 0 OR k % 19 = 0) AS gone FROM o),
m AS (SELECT *, coalesce(given, sid) AS cid, CASE WHEN sid <= 10 THEN (sid - 1) % 7 + 1 END AS sm, CASE WHEN coalesce(given, sid) <= 10 THEN (coalesce(given, sid) - 1) % 7 + 1 END AS cm FROM s),
a AS (SELECT *, CASE WHEN keep_s THEN coalesce(sn, sm) ELSE coalesce(sm, sn) END AS sc, CASE WHEN keep_c THEN coalesce(cn, cm) ELSE coalesce(cm, cn) END AS cc FROM m),
cases AS (SELECT run_date, k AS row_index, CASE WHEN r AND k % 10 <> 0 THEN 'r' WHEN k % 4 = 0 THEN 'q' ELSE 'l' END AS photo_url, sid || 'T' AS suggested_subject, coalesce(sc, cc) AS suggested_class, cid || 'T' AS confirmed_subject,
  coalesce(cc, sc) AS confirmed_class, gone AS exclude_row, cid, concat_ws('; ', CASE WHEN keep_s THEN 'in a pot; keep_suggested_varietal=1' WHEN keep_c THEN 'varietal_lock=1' END, 'phase2_start=1',
  CASE WHEN keep_s THEN 'phase2_micro_env=indoor_artificial_light' ELSE 'phase2_micro_env=outdoor_sun' END, CASE WHEN gone THEN 'exclude_row=1' END, CASE WHEN NOT keep_s AND sn <> sm THEN 'suggested_varietal_aligned_to_pot_map=1' END,
  CASE WHEN NOT keep_c AND cn <> cm THEN 'confirmed_varietal_aligned_to_pot_map=1' END, CASE WHEN NOT r THEN 'phase2_fallback=accepted_queue_suggestion' END) AS notes FROM a)"""


@query(f"WITH {_CASES} SELECT * EXCLUDE (cid) FROM cases")
def review_canonical(spark, sf_dir):
    return _cases(spark, sf_dir).drop("asset")


@query(f"""WITH {_CASES}, e AS (SELECT run_date, cid, count(*) AS n FROM cases WHERE NOT exclude_row AND cid IS NOT NULL GROUP BY ALL)
SELECT run_date, 'duplicate' AS code, cid AS subject_number FROM e WHERE n > 1 UNION ALL
SELECT run_date, 'missing', i FROM (SELECT DISTINCT run_date FROM cases) d, range(1, 9) t(i) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_date = d.run_date AND e.cid = i)""")
def review_checks(spark, sf_dir):
    return review.subject_checks(_cases(spark, sf_dir), 8)


# ---- tags of two runs


def _tags(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    number = lambda e: e.cast("string")
    raw = ad.table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").cast("string").alias("run_date"), F.concat(F.lit(" "), number(k)).alias("row_index"), F.concat(F.lit("a"), number(c)).alias("asset"), F.lit(" u ").alias("photo_url"),
        F.concat(F.lit("00"), number(c % 9), F.lit("t")).alias("suggested_subject"), F.concat(F.lit("no "), number(k % 5)).alias("suggested_class"),
        F.concat(number(F.when(k % 10 == 0, c % 7).otherwise(c % 9)), F.lit("T")).alias("confirmed_subject"), F.concat(F.lit("#"), number(F.when(k % 4 == 0, c % 5).otherwise(k % 5))).alias("confirmed_class"),
        F.when(k % 3 == 0, "on").when(k % 3 == 1, "Yes").otherwise("0").alias("reviewed"), F.lit("").alias("notes"), k.alias("o"),
    )
    return review.tag_rows(raw.filter("o % 3 <> 0")), review.tag_rows(raw.filter("o % 2 = 0")).withColumn("seq", F.lit(1))


_TAGS = """tags AS (SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS run_date, o_orderkey AS row_index, concat('a', CAST(o_custkey AS VARCHAR)) AS asset, nullif(o_custkey % 9, 0) AS s, nullif(o_orderkey % 5, 0) AS sc,
  nullif(CASE WHEN o_orderkey % 10 = 0 THEN o_custkey % 7 ELSE o_custkey % 9 END, 0) AS c, nullif(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 5 ELSE o_orderkey % 5 END, 0) AS cc, o_orderkey % 3 = 1 AS reviewed
  FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0)"""


def _handed(spark, sf_dir):
    base, incoming = _tags(spark, sf_dir)
    return merge.upsert(base, incoming, review.KEYS, "seq")


@query(f"WITH {_TAGS} SELECT run_date, row_index, asset, s || 'T' AS suggested_subject, sc AS suggested_class, c || 'T' AS confirmed_subject, cc AS confirmed_class, reviewed FROM tags")
def tag_handoff(spark, sf_dir):
    return _handed(spark, sf_dir).drop("photo_url", "notes")


@query(f"WITH {_TAGS} SELECT run_date, count(*) AS rows, count(*) FILTER (reviewed) AS reviewed_rows, count(*) FILTER (c IS DISTINCT FROM s OR cc IS DISTINCT FROM sc) AS changed_rows FROM tags GROUP BY run_date")
def tag_summary(spark, sf_dir):
    return review.tag_summary(_handed(spark, sf_dir))


@query(f"WITH {_TAGS} SELECT c || 'T' AS subject_id, string_agg(DISTINCT CAST(cc AS VARCHAR), ',' ORDER BY CAST(cc AS VARCHAR)) AS classes FROM tags WHERE c IS NOT NULL AND cc IS NOT NULL GROUP BY c HAVING count(DISTINCT cc) > 1")
def tag_conflicts(spark, sf_dir):
    return review.several_classes(_handed(spark, sf_dir)).select("subject_id", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"))


# ---- runs

_CARDS = f"""{catalog._RESOLVED}, cards AS (SELECT run_date, count(*) AS rows, count(DISTINCT subject_id) AS subjects, count(*) FILTER (ocr_confirmed) AS confirmed_rows,
  count(*) FILTER (resolution_source IN ('baseline_continuity', 'historical_continuity', 'series_map', 'sequence_inference', 'manual_override')) AS continuity_rows,
  32 - count(DISTINCT CASE WHEN CAST(replace(subject_id, 'T', '') AS BIGINT) BETWEEN 1 AND 32 THEN subject_id END) AS missing,
  array_to_string([concat(CAST(i AS VARCHAR), 'T') FOR i IN range(1, 33) IF NOT list_contains(list(subject_id), concat(CAST(i AS VARCHAR), 'T'))], ',') AS missing_ids FROM resolved WHERE dropped IS NULL GROUP BY run_date)"""


@query(f"WITH {_CARDS} SELECT * FROM cards")
def run_cards(spark, sf_dir):
    return _cards(catalog._resolved(spark, sf_dir)[0])


def _cards(rows):
    return report.run_cards(rows, lookup.CONTINUITY, 32).withColumn("missing_ids", F.array_join("missing_ids", ","))


@query(f"WITH {ad.INTAKE} SELECT run_date, row_index, row_number() OVER (PARTITION BY run_date ORDER BY row_index) AS position FROM intake QUALIFY position <= 20")
def first_of_run(spark, sf_dir):
    return review.first_of_run(ad.intake(spark, sf_dir).select("run_date", "row_index"), 20)[0]


@query(f"WITH {ad.INTAKE} SELECT run_date, count(*) AS rows FROM intake GROUP BY run_date HAVING count(*) < (SELECT avg(n) FROM (SELECT count(*) AS n FROM intake GROUP BY run_date))")
def short_runs(spark, sf_dir):
    rows = ad.intake(spark, sf_dir)
    mean = rows.agg(F.count("*") / F.count_distinct("run_date")).first()[0]
    return review.first_of_run(rows, mean)[1]


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1 ORDER BY n DESC, value LIMIT 1")
def top_category(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = e.agg(F.max("day").alias("_last"))
    return report.top_category(e.join(F.broadcast(last), F.col("day") == F.col("_last")), "event_type")


# ---- metrics and annotation


@query(f"""WITH {ad.METRICS} SELECT count(*) AS subjects, round(avg(focus), 3) AS mean_focus, round(avg(coverage), 6) AS mean_coverage, round(avg(inner_spill), 6) AS mean_inner_spill, round(avg(neighbor_spill), 6) AS mean_neighbor_spill,
 round(count(CASE WHEN growth > 0 THEN growth END) / count(*), 3) AS growth_availability, count(*) FILTER (step = 'ready') AS ready FROM (SELECT m.*, s.next_step AS step FROM metrics m JOIN ({oracle_sql()["metric_scores"]}) s USING (part))""")
def metric_summary(spark, sf_dir):
    c = [F.col(n) for n in ("focus", "inner_spill", "neighbor_spill", "coverage", "chlorosis", "plants", "growth")]
    m = ad.metrics(spark, sf_dir).withColumn("next_step", scores.next_step(F.lit(False), *c))
    return report.metric_summary(m.withColumn("growth", F.when(F.col("growth") > 0, F.col("growth"))))


@query(f"""WITH t AS ({oracle_sql()["ingest_status"]}), c AS (SELECT count(*) AS tasks, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status IN ('pending', 'started_empty')) AS pending FROM t)
SELECT *, CASE WHEN ready >= 8 THEN 'benchmark' WHEN ready >= 4 THEN 'baseline' WHEN pending > 0 THEN 'annotate' ELSE 'unblock' END AS advice FROM c""")
def ingest_summary(spark, sf_dir):
    return report.ingest_summary(records.ingest_status(spark, sf_dir))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '7T' WHEN o_custkey % 3 = 0 AND o_orderkey % 2 = 0 THEN '3T' ELSE concat(CAST(o_custkey % 9 AS VARCHAR), 'T') END AS effective,
 o_custkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_custkey % 9 <> 3 AS mismatch FROM orders""")
def identity_verdicts(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    v = review.identity_verdict(F.when(k % 5 == 0, " 7t").otherwise(""), F.concat((c % 9).cast("string"), F.lit("t")), F.when(c % 3 == 0, "reject_prefilled").otherwise("accept_prefilled"), F.when(k % 2 == 0, "3t"))
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", v["effective"].alias("effective"), v["mismatch"].alias("mismatch"))


@query("""WITH o AS (SELECT o_orderkey AS row_index, CASE WHEN o_orderkey % 3 = 0 THEN 'Tomato 5' WHEN o_orderkey % 3 = 1 THEN 'zz' ELSE '' END AS crop, CASE WHEN o_orderkey % 2 = 0 THEN 'a tomato plant' ELSE '' END AS whole FROM orders)
SELECT row_index, CASE WHEN crop = 'Tomato 5' OR whole <> '' THEN 'tomato' ELSE 'unknown' END AS label, CASE WHEN crop = 'Tomato 5' THEN crop ELSE nullif(concat_ws(' | ', nullif(crop, ''), nullif(whole, '')), '') END AS ocr_excerpt FROM o""")
def two_tier_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = ad.table(spark, sf_dir, "orders").select(
        k.alias("row_index"), F.lit("").alias("caption"), F.lit("").alias("notes"), F.when(k % 3 == 0, "Tomato 5").when(k % 3 == 1, " zz").otherwise("").alias("crop"), F.when(k % 2 == 0, "a tomato plant").alias("whole")
    )
    return review.two_tier_labels(rows, "crop", "whole").select("row_index", "label", "ocr_excerpt")


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), x AS (SELECT label + 1 AS s, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM e),
m AS (SELECT s, p, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY ALL), t AS (SELECT s, list(v ORDER BY p) AS t, sqrt(sum(v * v)) AS n FROM m GROUP BY s),
d AS (SELECT vec_id, s, round(list_dot_product(CAST(embedding AS DOUBLE[]), t.t) / n / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) AS score FROM e, t WHERE e.label = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, s) AS k FROM d),
f AS (SELECT vec_id, max(s) FILTER (k = 1) AS visual, string_agg(CAST(s AS VARCHAR), ',' ORDER BY k) AS top3 FROM r WHERE k <= 3 GROUP BY vec_id)
SELECT vec_id AS row_key, CASE WHEN vec_id % 3 = 0 THEN 4 ELSE visual END AS number, CASE WHEN vec_id % 3 = 0 THEN 5 ELSE 0 END AS votes, CASE WHEN vec_id % 3 = 0 THEN 'ocr_high' ELSE 'needs_manual' END AS tier, top3 FROM f WHERE CASE WHEN vec_id % 3 = 0 THEN 4 ELSE visual END <= 8""")
def hard_rows(spark, sf_dir):
    e = ad.table(spark, sf_dir, "embeddings").withColumn("number", (F.col("label") + 1).cast("long"))
    known = similarity.templates(e, "number", "embedding")
    rows = e.select(F.col("vec_id").alias("row_key"), "embedding")
    tries = rows.filter("row_key % 3 = 0").select("row_key", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("variant"), F.array(F.lit(4).cast("long")).alias("numbers"))
    found = similarity.hard_rows(rows, e.filter("label <> 1").select(F.col("vec_id").alias("row_key")), "embedding", known.withColumnRenamed("number", "label"), "label", similarity.votes(tries), 8)
    return found.select("row_key", "number", "votes", "tier", "top3")


@query(f"""WITH {ad.METRICS}, r AS (SELECT part, {records._READY} AS readiness, growth FROM metrics)
SELECT part, readiness, row_number() OVER (ORDER BY CASE readiness WHEN 'high' THEN 0 ELSE 1 END, CAST(part AS VARCHAR)) AS rank FROM r WHERE growth >= 0.25 AND readiness IN ('high', 'moderate') QUALIFY rank <= 6""")
def reference_subjects(spark, sf_dir):
    m = ad.metrics(spark, sf_dir).withColumn("readiness", scores.readiness(F.col("focus"), F.col("inner_spill"), F.col("coverage"), F.col("growth")))
    return rank.top_k(m.filter((F.col("growth") >= 0.25) & F.col("readiness").isin("high", "moderate")).select("part", "readiness"), [F.when(F.col("readiness") == "high", 0).otherwise(1), F.col("part").cast("string")], 6)
