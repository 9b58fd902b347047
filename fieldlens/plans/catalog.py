"""Registered queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, scores, text
from ..operators import boxes, lookup, merge, quality, rank, report, resolve, season, similarity
from ..sources.shared import stored
from . import adapters as ad
from .registry import query

# ---- identity resolution

_RESOLVED = f"""{ad.INTAKE}, {ad.DIMS}, {ad.OVERRIDES},
pos AS (SELECT i.*, row_number() OVER (PARTITION BY run_date ORDER BY row_index) AS run_position, o_subject, o_class, coalesce(o_exclude, FALSE) AS excluded, o_subject IS NOT NULL AS has_o
  FROM intake i LEFT JOIN overrides USING (run_date, row_index, asset)),
det AS (SELECT *, coalesce(CASE WHEN notes <> '' AND user_id % 40 > 0 THEN concat(CAST(user_id % 40 AS VARCHAR), 'T') END, o_subject) AS detected FROM pos),
seq AS (SELECT *, detected IS NULL AS inferred, coalesce(detected, concat(CAST(run_position AS VARCHAR), 'T')) AS subject0,
  CASE WHEN detected IS NULL AND run_position > 32 AND NOT excluded THEN 'extra' WHEN excluded THEN 'excluded' END AS dropped FROM det),
cls AS (SELECT s.*, fixed_class, baseline_name, baseline_class, coalesce(fixed_class, baseline_class) AS class0 FROM seq s
  LEFT JOIN fixed f ON s.subject0 = f.subject_id LEFT JOIN base b ON s.subject0 = b.subject_id),
nam AS (SELECT c.*, n.series_name AS name0, m.series_name AS o_name FROM cls c LEFT JOIN series n ON c.class0 = n.series_number LEFT JOIN series m ON c.o_class = m.series_number),
fin AS (SELECT *, coalesce(o_subject, subject0) AS subject_id, coalesce(o_class, class0) AS class_number, coalesce(o_name, name0) AS variety_name FROM nam),
resolved AS (SELECT run_date, row_index, subject_id, CAST(class_number AS BIGINT) AS class_number, variety_name,
  CASE WHEN variety_name IS NULL THEN 'review_needed_variety' ELSE 'ready_auto_resolved' END AS final_status,
  CASE WHEN variety_name IS NULL THEN 'manual_review' WHEN has_o THEN 'manual_row_override' WHEN fixed_class IS NOT NULL THEN 'manual_override'
    WHEN baseline_class IS NOT NULL THEN 'baseline_continuity' WHEN inferred THEN 'sequence_inference' ELSE 'direct_detection' END AS resolution_source,
  CASE WHEN subject_id = concat(CAST(user_id % 40 AS VARCHAR), 'T') OR subject_id = concat(CAST(event_id % 90 AS VARCHAR), 'T') THEN TRUE ELSE FALSE END AS ocr_confirmed,
  CASE WHEN subject0 = concat(CAST(user_id % 40 AS VARCHAR), 'T') OR subject0 = concat(CAST(event_id % 90 AS VARCHAR), 'T') THEN TRUE ELSE FALSE END AS counted,
  inferred, dropped FROM fin)"""


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ad.intake(spark, sf_dir)
    over = ad.overrides(rows)
    return resolve.resolve_identities(rows, *ad.dims(spark, sf_dir), over), over


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """_resolved, with the rows stored, for those who read them more than once."""
    rows, over = _resolved(spark, sf_dir)
    return stored(rows, "resolved-rows"), over


_CORE = ["run_date", "row_index", "subject_id", "class_number", "variety_name", "final_status", "resolution_source", "ocr_confirmed", "dropped"]


@query(f"WITH {_RESOLVED} SELECT {', '.join(_CORE)} FROM resolved")
def identity_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select(*_CORE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity_resolution(spark, sf_dir)


@query(f"""WITH {_RESOLVED} SELECT run_date, count(*) AS total_rows, count(*) FILTER (dropped IS NULL) AS kept_rows, count(*) FILTER (dropped = 'extra') AS skipped_rows,
  count(*) FILTER (dropped = 'excluded') AS excluded_rows, count(*) FILTER (inferred AND coalesce(dropped, '') <> 'extra') AS inferred_rows,
  count(*) FILTER (counted AND coalesce(dropped, '') <> 'extra') AS confirmed_rows, count(DISTINCT CASE WHEN dropped IS NULL THEN subject_id END) AS subjects,
  count(*) FILTER (dropped IS NULL AND final_status = 'ready_direct') AS ready_direct, count(*) FILTER (dropped IS NULL AND final_status = 'ready_auto_resolved') AS ready_auto,
  count(*) FILTER (dropped IS NULL AND final_status LIKE 'review_needed%') AS review_needed, least(count(*), 32) AS expected_rows FROM resolved GROUP BY run_date""")
def run_report(spark, sf_dir):
    return resolve.run_report(_resolved(spark, sf_dir)[0], 32)


@query(f"""WITH {_RESOLVED}, kept AS (SELECT * FROM resolved WHERE dropped IS NULL),
each AS (SELECT run_date, subject_id, count(*) AS n, count(DISTINCT variety_name) AS v FROM kept GROUP BY ALL),
missing AS (SELECT run_date, count(DISTINCT event_id % 30 + 1) AS m FROM intake WHERE event_id % 100 = 7 GROUP BY run_date),
cnt AS (SELECT r.run_date, coalesce(e.n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT DISTINCT run_date FROM resolved) r
  LEFT JOIN (SELECT run_date, count(*) AS n FROM each GROUP BY run_date) e USING (run_date) LEFT JOIN missing USING (run_date))
SELECT run_date, 'duplicate_subject' AS code, subject_id AS item FROM each WHERE n > 1 UNION ALL SELECT run_date, 'conflicting_names', subject_id FROM each WHERE v > 1
UNION ALL SELECT run_date, 'missing_variety_name', CAST(row_index AS VARCHAR) FROM kept WHERE variety_name IS NULL
UNION ALL SELECT run_date, 'subject_count', CAST(n AS VARCHAR) FROM cnt WHERE n <> greatest(32 - m, 0)""")
def identity_violations(spark, sf_dir):
    rows, over = _resolved(spark, sf_dir)
    return resolve.violations(rows, over, 32)


@query(f"""WITH {_RESOLVED}, days AS (SELECT run_date, row_number() OVER (ORDER BY run_date DESC) AS k FROM (SELECT DISTINCT run_date FROM resolved)),
last AS (SELECT k, subject_id, max_by({{'v': variety_name, 's': resolution_source, 'o': ocr_confirmed}}, row_index) AS r FROM resolved JOIN days USING (run_date) WHERE k <= 2 AND dropped IS NULL GROUP BY ALL),
spine AS (SELECT concat(CAST(i AS VARCHAR), 'T') AS subject_id FROM range(1, 33) t(i)),
j AS (SELECT s.subject_id, a.r AS a, b.r AS b FROM spine s LEFT JOIN last a ON a.k = 2 AND a.subject_id = s.subject_id LEFT JOIN last b ON b.k = 1 AND b.subject_id = s.subject_id)
SELECT subject_id, a.v AS variety_name_a, b.v AS variety_name_b, coalesce(b.v, a.v, 'unknown') AS variety_name,
 CASE WHEN a IS NULL OR b IS NULL THEN 'warn' WHEN a.v <> b.v THEN 'drift'
  WHEN a.s IN ('baseline_continuity', 'historical_continuity', 'series_map', 'sequence_inference', 'manual_override') AND b.s IN ('baseline_continuity', 'historical_continuity', 'series_map', 'sequence_inference', 'manual_override')
   AND NOT a.o AND NOT b.o THEN 'risk' WHEN a.o AND b.o THEN 'ok' ELSE 'info' END AS status FROM j""")
def run_comparison(spark, sf_dir):
    return _comparison(spark, _kept(spark, sf_dir)[0])


def _comparison(spark, rows):
    rows = rows.filter("dropped IS NULL")
    days = [r["run_date"] for r in rows.select("run_date").distinct().orderBy(F.desc("run_date")).limit(2).collect()]
    first, second = lookup.run_pair(days)
    side = lambda d: rank.latest(rows.filter(F.col("run_date") == F.lit(d)), "subject_id", [F.col("row_index")])
    spine = spark.range(1, 33).select(F.concat(F.col("id").cast("string"), F.lit("T")).alias("subject_id"))
    return lookup.compare_runs(side(first), side(second), spine)


@query(f"""WITH {_RESOLVED} SELECT i AS subject_number, coalesce(runs, 0) AS runs, coalesce(named, 0) AS named FROM range(1, 41) t(i) LEFT JOIN (
 SELECT CAST(replace(subject_id, 'T', '') AS BIGINT) AS i, count(*) AS runs, count(v) AS named FROM (SELECT subject_id, run_date, max_by(variety_name, row_index) FILTER (variety_name IS NOT NULL) AS v
 FROM resolved WHERE dropped IS NULL GROUP BY ALL) GROUP BY 1) USING (i)""")
def subject_timeline(spark, sf_dir):
    rows = _resolved(spark, sf_dir)[0].filter("dropped IS NULL").withColumn("subject_number", ids.subject_number(F.col("subject_id")))
    rows = rows.withColumn("variety_name", F.col("variety_name"))
    out = rank.timeline(rows.withColumn("row_index", F.when(F.col("variety_name").isNotNull(), F.col("row_index"))), 40)
    return out.select("subject_number", "runs", F.coalesce(F.size(F.filter("cells", lambda c: c["variety_name"].isNotNull())), F.lit(0)).cast("long").alias("named"))


@query(f"""WITH {_RESOLVED} SELECT 'several_classes' AS code, subject_id AS item FROM resolved GROUP BY subject_id HAVING count(DISTINCT class_number) > 1
UNION ALL SELECT 'several_names', subject_id FROM resolved GROUP BY subject_id HAVING count(DISTINCT variety_name) > 1
UNION ALL SELECT 'duplicate_in_run', concat(strftime(run_date, '%Y-%m-%d'), '|', subject_id) FROM resolved GROUP BY run_date, subject_id HAVING count(*) > 1""")
def phase_consistency(spark, sf_dir):
    return quality.phase_consistency(_resolved(spark, sf_dir)[0])


# ---- expressions


@query("""SELECT event_id, CASE WHEN user_id > 0 AND user_id < 1000 THEN concat(CAST(user_id AS VARCHAR), 'T') END AS subject_id, CASE WHEN user_id > 0 THEN user_id END AS class_number,
 list_distinct_keep AS candidates, event_type IN ('view', 'click') AS is_view FROM (SELECT *, CASE WHEN user_id % 40 = 0 AND event_id % 90 = 0 THEN '' WHEN user_id % 40 = 0 OR user_id % 40 = event_id % 90 THEN CAST(event_id % 90 AS VARCHAR)
 WHEN event_id % 90 = 0 THEN CAST(user_id % 40 AS VARCHAR) ELSE concat(CAST(user_id % 40 AS VARCHAR), ',', CAST(event_id % 90 AS VARCHAR)) END AS list_distinct_keep FROM events)""")
def id_normalisation(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    number = F.col("user_id").cast("string")
    # lpad cuts longer texts
    raw = F.concat(F.lit(" "), F.lpad(number, F.greatest(F.length(number), F.lit(3)), "0"), F.lit("-t "))
    numbers = ids.number_candidates(F.concat(F.lit("no "), (F.col("user_id") % 40).cast("string"), F.lit(" of "), (F.col("event_id") % 90).cast("string")))
    return e.select(
        "event_id", ids.subject_id(raw).alias("subject_id"), ids.class_number(F.concat(F.lit("#"), F.col("user_id").cast("string"))).alias("class_number"),
        F.array_join(F.transform(numbers, lambda x: x.cast("string")), ",").alias("candidates"), F.col("event_type").isin("view", "click").alias("is_view"),
    )


@query(f"""WITH {ad.INTAKE} SELECT row_index, CASE WHEN caption <> '' THEN concat('Plant ', CAST(user_id % 40 AS VARCHAR)) END AS variety, CASE WHEN caption <> '' THEN 'p1' END AS plant,
 CASE WHEN caption <> '' THEN 'phone' ELSE 'unknown' END AS source, CASE WHEN caption = '' THEN 'too_few_parts' END AS reject,
 CASE WHEN caption <> '' THEN concat('plant_', CAST(user_id % 40 AS VARCHAR)) END AS variety_slug FROM intake""")
def caption_split(spark, sf_dir):
    c = text.caption_parts(F.col("caption"))
    rows = ad.intake(spark, sf_dir).select("row_index", c.alias("c")).select("row_index", "c.variety", "c.plant", "c.source", "c.reject")
    blank = F.col("reject").isNotNull()
    return rows.select("row_index", F.when(~blank, F.col("variety")).alias("variety"), F.when(~blank, F.col("plant")).alias("plant"), "source", "reject", F.when(~blank, ids.slug(F.col("variety"))).alias("variety_slug"))


@query("SELECT doc_id, CASE WHEN trim(lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) = '' THEN 'unknown' "
       + " ".join(f"WHEN regexp_matches(lower(regexp_replace(text, '\\s+', ' ', 'g')), '{p}') THEN 'non_tomato'" for p, *_ in text.SPECIES_RULES)
       + " WHEN regexp_matches(lower(regexp_replace(text, '\\s+', ' ', 'g')), '" + "|".join(p.replace("'", "''") for p in text.TARGET_PATTERNS) + "') THEN 'tomato' ELSE 'unknown' END AS label FROM documents")
def text_labels(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select("doc_id", text.classify_text(F.col("text"))["label"].alias("label"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'label|number|stake') THEN 'identity' WHEN regexp_matches(lower(text), 'plant|leaf|fruit') THEN 'growth'
 WHEN contains(lower(text), 'background') THEN 'noise' ELSE 'review' END AS level, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'other' END AS role FROM conversations""")
def level_labels(spark, sf_dir):
    return ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.level_kind(F.col("text")).alias("level"), text.clamp_domain(F.col("role"), ["user", "assistant"], "other").alias("role"))


@query("""SELECT event_id, strftime(make_timestamp(event_id * 60000000), '%Y-%m-%dT%H:%M:%S') AS iso, CASE WHEN user_id % 2 = 0 THEN '+02:00' ELSE '-07:00' END AS zone,
 date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_since FROM events""")
def time_text(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    off = F.when(F.col("user_id") % 2 == 0, F.lit(7200000)).otherwise(F.lit(-25200000))
    return e.select(
        "event_id", text.iso_local(F.col("event_id") * 60000, F.lit(0)).alias("iso"), text.offset_text(off).alias("zone"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day_since")
    )


@query(f"""WITH {ad.INTAKE} SELECT row_index, sha1(concat(asset, '|', notes, '|', caption)) AS record, concat('manual_', CAST(row_index AS VARCHAR), '_', substr(sha1(asset), 1, 10)) AS made_id,
 lower(concat_ws(' ', asset, notes, caption)) AS blob FROM intake""")
def record_keys(spark, sf_dir):
    return ad.intake(spark, sf_dir).select(
        "row_index", text.record_hash(F.col("asset"), F.col("notes"), F.col("caption")).alias("record"), text.synthetic_id(F.col("row_index"), F.col("asset")).alias("made_id"),
        text.search_blob(F.col("asset"), F.col("notes"), F.col("caption")).alias("blob"),
    )


# ---- lookups


@query("""WITH d AS (SELECT o_custkey, o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS run_date FROM orders WHERE o_orderkey % 3 <> 0)
SELECT o.o_orderkey, (SELECT max_by(d.o_orderpriority, (d.run_date, d.o_orderkey)) FROM d WHERE d.o_custkey = o.o_custkey AND d.run_date < CAST(o.o_orderdate AS DATE)) AS historical FROM orders o""")
def historical_lookup(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject"), F.to_date("o_orderdate").alias("run_date"), F.col("o_orderkey").alias("row_index"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("v")
    )
    return lookup.history(o, "subject", "v").select(F.col("row_index").alias("o_orderkey"), "historical")


_PHASES = [("p1", "one", "", "1995-01-01", "1995-12-31", None, None, 2), ("p2", "two", "", "1995-06-15", "1996-06-30", "Begin", "Close", 1), ("p3", "three", "other", "1996-01-01", "1997-01-01", None, None, 0)]


@query("""WITH phases(phase_id, s, e, priority) AS (VALUES ('p1', DATE '1995-01-01', DATE '1995-12-31', 2), ('p2', DATE '1995-06-15', DATE '1996-06-30', 1)),
b AS (SELECT d, min_by({'p': phase_id, 's': s, 'e': e}, priority) AS x FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) JOIN phases ON d BETWEEN s AND e GROUP BY d)
SELECT o_orderkey, x.p AS phase_id, CASE WHEN x IS NULL THEN NULL WHEN d = x.s THEN 'phase_start' WHEN d = x.e THEN 'phase_end' ELSE 'phase_window' END AS phase_boundary,
 CASE WHEN d = x.s THEN CASE x.p WHEN 'p2' THEN 'Begin' ELSE 'Phase Start' END WHEN d = x.e THEN CASE x.p WHEN 'p2' THEN 'Close' ELSE 'Phase End' END END AS phase_day_label
FROM orders LEFT JOIN b ON d = CAST(o_orderdate AS DATE)""")
def phase_lookup(spark, sf_dir):
    schema = "phase_id string, phase_name string, lifecycle_stage string, start_date string, end_date string, start_label string, end_label string, priority int"
    phases = spark.createDataFrame(_PHASES, schema).withColumns({c: F.to_date(c) for c in ("start_date", "end_date")})
    runs = ad.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("run_date"))
    return lookup.phase_of(runs, phases, F.lit("sapling")).select("o_orderkey", "phase_id", "phase_boundary", "phase_day_label")


@query("""WITH f AS (SELECT o_custkey, min_by(o_totalprice, (CAST(o_orderdate AS DATE), o_orderkey)) AS b FROM orders GROUP BY o_custkey)
SELECT o_orderkey, CASE WHEN b > 0 THEN (o_totalprice - b) / b END AS growth, CASE WHEN (o_totalprice - b) / b >= 0.25 THEN 'strong' WHEN (o_totalprice - b) / b >= 0 THEN 'modest'
 WHEN (o_totalprice - b) / b <= -0.25 THEN 'stalled' ELSE 'flat' END AS bucket FROM orders JOIN f USING (o_custkey)""")
def baseline_growth(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("row_index"), F.to_date("o_orderdate").alias("capture_date"), "o_totalprice")
    b = lookup.earliest(o, "o_custkey", ["o_totalprice"])
    g = scores.growth(F.col("o_totalprice"), F.col("base_o_totalprice"))
    return o.join(b, "o_custkey").select("o_orderkey", g.alias("growth"), text.delta_bucket(g).alias("bucket"))


@query("""SELECT coalesce(b.k, o.k) AS k, coalesce(o.v, b.v) AS v FROM (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0) b
 FULL JOIN (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0) o ON b.k = o.k""")
def layered_map(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer")
    side = lambda cond, v: c.filter(cond).select(F.col("c_custkey").alias("k"), F.col(v).alias("v"))
    return lookup.layered(side("c_custkey % 3 <> 0", "c_mktsegment"), side("c_custkey % 2 = 0", "c_name"), "k", ["v"])


# ---- merges


def _feeds(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("created"))
    again = o.filter("k % 10 = 0").withColumn("price", F.col("price") + 2).withColumn("seq", F.lit(2))
    incoming = o.filter("k % 2 = 0").select("k", (F.col("price") + 1).alias("price"), F.lit("new").alias("created"), F.lit(1).alias("seq")).unionByName(again)
    return o.filter("k % 3 <> 0"), incoming


_FEEDS = """base AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderpriority AS created FROM orders WHERE o_orderkey % 3 <> 0),
inc AS (SELECT o_orderkey AS k, o_totalprice + 1 AS price, 'new' AS created, 1 AS seq FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_orderkey, o_totalprice + 2, o_orderpriority, 2 FROM orders WHERE o_orderkey % 10 = 0)"""


@query(f"""WITH {_FEEDS}, last AS (SELECT k, max_by({{'price': price, 'created': created}}, seq) AS r FROM inc GROUP BY k)
SELECT coalesce(b.k, l.k) AS k, coalesce(r.price, b.price) AS price, coalesce(b.created, r.created) AS created FROM base b FULL JOIN last l ON b.k = l.k""")
def keyed_upsert(spark, sf_dir):
    base, inc = _feeds(spark, sf_dir)
    return merge.upsert(base, inc, ["k"], "seq", keep=("created",))


@query(f"""WITH {_FEEDS}, n AS (SELECT count(DISTINCT k) AS i FROM inc WHERE k NOT IN (SELECT k FROM base))
SELECT i AS inserted, (SELECT count(*) FROM inc) - i AS updated, (SELECT count(*) FROM base) + i AS output FROM n""")
def upsert_counts(spark, sf_dir):
    base, inc = _feeds(spark, sf_dir)
    return merge.upsert_counts(base, inc, ["k"])


@query("""WITH o AS (SELECT event_id AS k, CAST(ts AS DATE) AS d FROM events WHERE event_id % 7 <> 0 AND event_id < (SELECT count(*) * 0.8 FROM events)),
n AS (SELECT event_id AS k, CAST(ts AS DATE) AS d FROM events WHERE event_id % 11 <> 0), j AS (SELECT o.k AS ok, n.k AS nk, coalesce(n.d, o.d) AS d FROM o FULL JOIN n ON o.k = n.k)
SELECT d AS day, count(nk) AS rows, count(*) FILTER (ok IS NULL) AS added, count(*) FILTER (nk IS NULL) AS removed, count(*) FILTER (ok IS NULL AND d >= (SELECT max(d) FROM o)) AS forward FROM j GROUP BY d""")
def snapshot_diff(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.to_date("ts").alias("day"))
    n = e.count()
    return merge.snapshot_diff(e.filter((F.col("k") % 7 != 0) & (F.col("k") < n * 0.8)), e.filter("k % 11 <> 0"), "k", "day")


@query("""WITH u AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS k, c_custkey AS o, c_name AS v, 0 AS f FROM customer
 UNION ALL SELECT s_nationkey, s_suppkey, s_name, 1 FROM supplier)
SELECT k, min_by(o, (f, o)) AS o, min_by(v, (f, o)) AS v FROM u WHERE k IS NOT NULL GROUP BY k UNION ALL SELECT k, o, v FROM u WHERE k IS NULL""")
def union_first(spark, sf_dir):
    c = ad.table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("k"), F.col("c_custkey").alias("o"), F.col("c_name").alias("v"))
    s = ad.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("o"), F.col("s_name").alias("v"))
    return merge.first_of_each([c, s], "k", "o")


@query("SELECT i AS user_id FROM range(1, 1001) t(i) WHERE i NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def missing_of_spine(spark, sf_dir):
    return merge.missing_of_spine(ad.table(spark, sf_dir, "events").filter("event_type = 'error'"), "user_id", 1000)


# ---- order and rank


@query(f"""WITH {ad.INTAKE} SELECT CASE WHEN user_id > 0 THEN concat(CAST(user_id AS VARCHAR), 'T') END AS subject_id, max(run_date) AS run_date,
 max_by(row_index, (run_date, CAST(row_index AS VARCHAR))) AS row_index FROM intake WHERE user_id > 0 GROUP BY 1""")
def latest_per_subject(spark, sf_dir):
    rows = ad.intake(spark, sf_dir).withColumn("subject_id", ids.subject_id(F.col("user_id").cast("string"), "loose")).withColumn("captured_at", F.lit(""))
    return rank.latest_per_subject(rows).select("subject_id", "run_date", "row_index")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem")
def global_rank(spark, sf_dir):
    order = [-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return rank.global_rank(ad.table(spark, sf_dir, "lineitem"), order).select("l_orderkey", "l_linenumber", "rank")


@query(f"""WITH {ad.METRICS} SELECT part, round(0.65 * focus + 0.25 * (1 - least(inner_spill, 1)) + 0.10 * least(coverage, 0.12) / 0.12, 9) AS score,
 row_number() OVER (ORDER BY round(0.65 * focus + 0.25 * (1 - least(inner_spill, 1)) + 0.10 * least(coverage, 0.12) / 0.12, 9) DESC, part) AS rank FROM metrics QUALIFY rank <= 8""")
def seed_selection(spark, sf_dir):
    m = ad.metrics(spark, sf_dir)
    s = F.round(scores.seed_score(F.col("focus"), F.least("inner_spill", F.lit(1.0)), F.col("coverage")), 9)
    return rank.top_k(m.select("part", s.alias("score")), [-F.col("score"), F.col("part")], 8)


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority, n, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rank FROM c QUALIFY rank <= 2""")
def top_labels(spark, sf_dir):
    return report.top_per_group(ad.table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", 2)


# ---- reports


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return report.value_counts(ad.table(spark, sf_dir, "events"), "event_type")


_PROFILE = f"""{ad.INTAKE}, prof AS (SELECT run_date, count(*) AS total_rows, count(*) FILTER (label = 'tomato') AS tomato_rows, count(*) FILTER (label = 'non_tomato') AS non_tomato_rows, count(*) FILTER (label = 'other') AS unknown_rows,
 round(avg(CASE WHEN caption <> '' THEN 1 ELSE 0 END), 4) AS caption_rate, round(avg(CASE WHEN ocr_excerpt <> '' THEN 1 ELSE 0 END), 4) AS ocr_rate,
 round(avg(CASE WHEN label <> 'other' THEN 1 ELSE 0 END), 4) AS non_unknown_rate, round(avg(CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END), 4) AS crop_rate, round(avg(CASE WHEN user_id * 25 <= 700 THEN 1 ELSE 0 END), 4) AS low_resolution_rate,
 round(avg(CASE WHEN user_id * 25 >= 2000 THEN 1 ELSE 0 END), 4) AS full_resolution_rate, round(median(value), 4) AS median_blur FROM intake GROUP BY run_date)"""


@query(f"WITH {_PROFILE} SELECT * FROM prof")
def batch_profile(spark, sf_dir):
    rows = ad.intake(spark, sf_dir).withColumns({"width": F.col("user_id") * 25, "height": F.lit(0).cast("long"), "blur": F.col("value"), "brightness": F.col("value"), "has_crop": F.col("event_id") % 6 == 0})
    return report.batch_profile(rows).drop("portrait_rate", "landscape_rate", "median_brightness")


# as resolved without overrides, where only runs of 30 to 34 rows are expected to have 32 subjects
_SIZED = (
    _RESOLVED.replace("event_id % 50 = 7 AND event_id % 4 <> 1", "FALSE")
    .replace("SELECT i.*, row_number() OVER (PARTITION BY run_date ORDER BY row_index)", "SELECT i.*, CASE WHEN count(*) OVER (PARTITION BY run_date) BETWEEN 30 AND 34 THEN 32 ELSE count(*) OVER (PARTITION BY run_date) END AS expected, row_number() OVER (PARTITION BY run_date ORDER BY row_index)")
    .replace("run_position > 32", "run_position > expected")
)


@query(f"""WITH p AS (WITH {_PROFILE} SELECT * FROM prof), r AS (WITH {_SIZED} SELECT run_date, round(avg(CASE WHEN inferred AND coalesce(dropped, '') <> 'extra' THEN 1 ELSE 0 END), 4) AS sequential_rate,
 round(avg(CASE WHEN counted AND coalesce(dropped, '') <> 'extra' THEN 1 ELSE 0 END), 4) AS confirmed_rate, round(avg(CASE WHEN dropped IS NULL AND final_status = 'ready_auto_resolved' THEN 1 ELSE 0 END), 4) AS auto_resolved_rate,
 round(avg(CASE WHEN dropped IS NULL AND resolution_source IN ('baseline_continuity', 'series_map', 'sequence_inference', 'manual_override') THEN 1 ELSE 0 END), 4) AS continuity_rate FROM resolved GROUP BY run_date)
SELECT *, CASE WHEN caption_rate >= 0.7 AND non_unknown_rate >= 0.6 AND full_resolution_rate >= 0.5 THEN 'baseline' WHEN total_rows BETWEEN 30 AND 34 AND sequential_rate >= 0.9 AND non_unknown_rate <= 0.2 THEN 'watering_day' ELSE 'random' END AS mode FROM p JOIN r USING (run_date)""")
def run_profile(spark, sf_dir):
    rows = ad.intake(spark, sf_dir)
    found = resolve.resolve_identities(rows, *ad.dims(spark, sf_dir), ad.overrides(rows).filter("false"), resolve.Params(usual_sizes=(30, 34)))
    p = batch_profile(spark, sf_dir).join(report.mapping_rates(found, lookup.CONTINUITY), "run_date")
    return p.withColumn("mode", report.run_mode(F.col("total_rows"), F.col("caption_rate"), F.col("non_unknown_rate"), F.col("full_resolution_rate"), F.col("sequential_rate")))


@query(f"""WITH {ad.METRICS}, l AS (SELECT 'coverage' AS metric, CASE WHEN coverage > 0.03 THEN coverage END AS v FROM metrics UNION ALL SELECT 'growth', growth FROM metrics UNION ALL SELECT 'plants', plants FROM metrics),
a AS (SELECT metric, count(v) / count(*) AS availability, CASE WHEN count(v) < 2 OR abs(avg(v)) < 1e-12 THEN 0 ELSE stddev_pop(v) / abs(avg(v)) END AS cv FROM l GROUP BY metric)
SELECT metric, round(availability, 9) AS availability, round(cv, 9) AS cv, CASE WHEN availability >= 0.9 AND cv >= 0.15 THEN 'helpful' WHEN availability >= 0.6 THEN 'promising' ELSE 'limited' END AS status FROM a""")
def metric_variation(spark, sf_dir):
    m = ad.metrics(spark, sf_dir).withColumn("coverage", F.when(F.col("coverage") > 0.03, F.col("coverage")))
    return report.variation(m, ["coverage", "growth", "plants"]).select("metric", F.round("availability", 9).alias("availability"), F.round("cv", 9).alias("cv"), "status")


@query("""WITH p AS (SELECT doc_id, CASE WHEN contains(text, '|') THEN 0 ELSE 1 END AS quality, CASE WHEN contains(lower(text), 'idiot') THEN 1 ELSE 0 END AS toxic FROM documents WHERE doc_id % 9 <> 0)
SELECT count(*) AS rows, count(*) FILTER (p.doc_id IS NULL) AS missing, avg(CASE WHEN l.quality = p.quality THEN 1 ELSE 0 END) AS quality_accuracy, avg(CASE WHEN l.toxic = p.toxic THEN 1 ELSE 0 END) AS toxic_accuracy,
 avg(CASE WHEN l.quality = p.quality AND l.toxic = p.toxic THEN 1 ELSE 0 END) AS joint_accuracy FROM labels l LEFT JOIN p USING (doc_id)""")
def label_calibration(spark, sf_dir):
    d = ad.table(spark, sf_dir, "documents").filter("doc_id % 9 <> 0")
    p = d.select("doc_id", F.when(F.col("text").contains("|"), 0).otherwise(1).alias("quality"), F.lower("text").contains("idiot").cast("int").alias("toxic"))
    return report.calibration(ad.table(spark, sf_dir, "labels"), p, "doc_id", ["quality", "toxic"])


@query("""WITH b AS (SELECT l_partkey AS part, CASE WHEN l_discount >= 0.08 THEN 'strong' WHEN l_discount >= 0.05 THEN 'modest' WHEN l_discount <= 0.0 THEN 'stalled' ELSE 'flat' END AS k FROM lineitem),
c AS (SELECT part, count(*) AS rows, count(*) FILTER (k = 'strong') AS strong, count(*) FILTER (k = 'modest') AS modest, count(*) FILTER (k = 'stalled') AS stalled FROM b GROUP BY part)
SELECT *, CASE WHEN stalled > 0 THEN 'mixed' WHEN strong = rows AND strong > 1 THEN 'leading' WHEN strong > 0 AND modest > 0 THEN 'mixed_promising' WHEN strong > 0 THEN 'positive' ELSE 'needs_proof' END AS signal FROM c""")
def signal_cards(spark, sf_dir):
    d = F.col("l_discount")
    rows = ad.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.when(d >= 0.08, "strong").when(d >= 0.05, "modest").when(d <= 0.0, "stalled").otherwise("flat").alias("k"))
    return report.signal_cards(rows, "part", "k").select("part", "rows", "strong", "modest", "stalled", "signal")


@query("SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s")
def status_groups(spark, sf_dir):
    return report.status_groups(ad.table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("""WITH t AS (SELECT l_orderkey AS row_key, l_linenumber AS variant, l_partkey % 9 AS a, l_suppkey % 9 AS b, l_orderkey % 9 AS truth FROM lineitem)
SELECT variant, count(*) AS rows, round(avg(CASE WHEN truth IN (a, b) THEN 1 ELSE 0 END), 4) AS match_rate FROM t GROUP BY variant""")
def variant_ranking(spark, sf_dir):
    return report.variant_ranking(_tries(spark, sf_dir)).select("variant", "rows", "match_rate")


def _tries(spark, sf_dir):
    k = lambda c: F.col(c) % 9
    return ad.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_key"), F.col("l_linenumber").alias("variant"), F.lit("x").alias("text"), F.array(k("l_partkey"), k("l_suppkey")).alias("numbers"), k("l_orderkey").alias("truth")
    )


@query("""WITH t AS (SELECT l_orderkey AS row_key, l_partkey % 9 AS a, l_suppkey % 9 AS b, l_orderkey % 9 AS truth FROM lineitem) SELECT row_key, bool_or(truth IN (a, b)) AS matched FROM t GROUP BY row_key""")
def ensemble_match(spark, sf_dir):
    return report.ensemble(_tries(spark, sf_dir))


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS row_key, l_linenumber AS variant, unnest([l_partkey % 9, l_suppkey % 9]) AS number FROM lineitem), v AS (SELECT row_key, number, count(*) AS votes FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY votes DESC, number) AS k, count(*) OVER (PARTITION BY row_key, votes) AS ties FROM v),
j AS (SELECT o_orderkey AS row_key, o_custkey % 9 AS visual, number, votes, ties, coalesce(votes >= 5 AND ties = 1, FALSE) AS high, coalesce(votes >= 4 AND ties = 1 AND o_custkey % 9 = number, FALSE) AS medium
 FROM orders LEFT JOIN r ON r.row_key = o_orderkey AND k = 1)
SELECT row_key, coalesce(number, visual) AS number, CASE WHEN high OR medium THEN votes ELSE 0 END AS votes, CASE WHEN high THEN 'ocr_high' WHEN medium THEN 'ocr_visual_medium' ELSE 'needs_manual' END AS tier FROM j""")
def vote_decisions(spark, sf_dir):
    voted = similarity.votes(_tries(spark, sf_dir))
    rows = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_key"), (F.col("o_custkey") % 9).alias("visual_top1"))
    return similarity.decisions(rows, voted)


# ---- scores


@query(f"""WITH {ad.METRICS}, s AS (SELECT *, least(greatest(0.7 * focus + 0.3 * (1 - neighbor_spill), 0), 1) AS sure FROM metrics),
h AS (SELECT *, round(least(greatest(32 * least(coverage / 0.08, 1) + 18 * least(greatest((growth + 0.30) / 1.10, 0), 1) + 15 * (1 - least(chlorosis * sure / 0.28, 1))
 + 15 * (1 - least((0.7 * inner_spill + 0.3 * neighbor_spill) / 0.5, 1)) + 12 * focus + 8 * greatest(0, 1 - abs(plants - 1.8) / 3), 0), 100), 2) AS health FROM s)
SELECT part, health, CASE WHEN focus >= 0.70 AND inner_spill <= 0.16 AND coverage >= 0.012 THEN 'high' WHEN focus >= 0.46 AND inner_spill <= 0.38 AND coverage >= 0.006 THEN 'moderate' WHEN focus >= 0.36 THEN 'moderate' ELSE 'low' END AS readiness,
 CASE WHEN coverage < 0.01 THEN 'low' WHEN health >= 74 AND coverage >= 0.07 AND growth >= -0.12 THEN 'high' WHEN health >= 45 THEN 'moderate' ELSE 'low' END AS survival,
 CASE WHEN focus < 0.35 THEN 'label_seed' WHEN inner_spill > 0.32 OR (neighbor_spill > 0.60 AND focus < 0.55) THEN 'disambiguate_neighbors' WHEN coverage < 0.012 THEN 'closer_photo'
  WHEN chlorosis >= 0.22 AND focus >= 0.62 AND inner_spill <= 0.18 AND coverage >= 0.02 THEN 'check_nutrients' WHEN plants >= 3 AND coverage > 0.040 THEN 'thin_seedlings' WHEN growth < -0.18 THEN 'check_growth' ELSE 'ready' END AS next_step,
 CASE WHEN blur < 30 OR brightness < 45 OR brightness > 225 OR coverage < 0.01 THEN concat_ws('|', CASE WHEN blur < 30 THEN 'blurry' END, CASE WHEN brightness < 45 THEN 'too_dark' END, CASE WHEN brightness > 225 THEN 'too_bright' END,
  CASE WHEN coverage < 0.01 THEN 'low_coverage' END) ELSE 'ok' END AS flags FROM h""")
def metric_scores(spark, sf_dir):
    c = {n: F.col(n) for n in ("coverage", "growth", "chlorosis", "inner_spill", "neighbor_spill", "focus", "plants", "blur", "brightness")}
    health = scores.health_v2(c["coverage"], c["growth"], c["chlorosis"], c["inner_spill"], c["neighbor_spill"], c["focus"], c["plants"])
    m = ad.metrics(spark, sf_dir).withColumn("health", health)
    return m.select(
        "part", "health", scores.readiness(c["focus"], c["inner_spill"], c["coverage"], c["growth"]).alias("readiness"), scores.survival(F.col("health"), c["coverage"], c["growth"]).alias("survival"),
        scores.next_step(F.lit(False), c["focus"], c["inner_spill"], c["neighbor_spill"], c["coverage"], c["chlorosis"], c["plants"], c["growth"]).alias("next_step"),
        scores.quality_flags_v1(c["blur"], c["brightness"], c["coverage"]).alias("flags"),
    )


# ---- annotation boxes


_BOXES = """b AS (SELECT l_orderkey AS photo, l_linenumber AS ord, l_returnflag = 'N' AS pot, l_suppkey % 12 + 1 AS c, l_discount * 10 AS cx, l_tax * 10 AS cy FROM lineitem)"""


# from subjects s (photo, s, sx, sy, expected) and class boxes v (photo, c, x, y, class) to verdicts r
_PAIRS = """e AS (SELECT photo, s, v.c, CASE WHEN expected = class THEN 1 ELSE 2 END AS pass, sqrt(pow(sx - x, 2) + pow(sy - y, 2)) AS d FROM s JOIN v USING (photo)),
o AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY pass, d, s, c) AS k FROM e),
f AS (SELECT photo, 0::BIGINT AS k, []::STRUCT(s BIGINT, c BIGINT, d DOUBLE)[] AS m FROM (SELECT DISTINCT photo FROM o)
 UNION ALL SELECT f.photo, o.k, CASE WHEN len(list_filter(m, lambda q: q.s = o.s OR q.c = o.c)) > 0 THEN m ELSE list_append(m, {'s': o.s, 'c': o.c, 'd': o.d}) END FROM f JOIN o ON o.photo = f.photo AND o.k = f.k + 1),
p AS (SELECT photo, unnest(max_by(m, k), recursive := true) FROM f GROUP BY photo),
j AS (SELECT s.photo, s.s AS subject_ord, p.c AS class_ord, p.d AS distance, expected, class FROM s LEFT JOIN p ON p.photo = s.photo AND p.s = s.s LEFT JOIN v ON v.photo = p.photo AND v.c = p.c),
r AS (SELECT photo, subject_ord, class_ord, round(distance, 6) AS distance, CASE WHEN class_ord IS NULL THEN 'missing_varietal_pair' WHEN coalesce(expected, 0) <= 0 THEN 'unknown_pot_series' WHEN class <> expected THEN 'pot_varietal_conflict' ELSE '' END AS review_reason,
 CASE WHEN class_ord IS NULL THEN 'pot_only' WHEN coalesce(expected, 0) <= 0 THEN 'pot_plus_varietal_unvalidated' WHEN class <> expected THEN 'pot_plus_varietal_conflict' ELSE 'pot_plus_varietal_match' END AS evidence_type FROM j
 UNION ALL SELECT photo, NULL, c, NULL, 'orphan_varietal_without_pot', 'varietal_only' FROM v WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.photo = v.photo AND p.c = v.c))"""


@query(f"""WITH RECURSIVE {_BOXES}, s AS (SELECT photo, ord AS s, cx AS sx, cy AS sy, CASE WHEN c < 11 THEN c END AS expected FROM b WHERE pot), v AS (SELECT photo, ord AS c, cx AS x, cy AS y, c AS class FROM b WHERE NOT pot),
{_PAIRS} SELECT *, review_reason <> '' AS needs_review FROM r""")
def box_pairing(spark, sf_dir):
    b = ad.photo_boxes(spark, sf_dir)
    subjects = b.filter("kind = 'pot'").select("photo", "ord", "cx", "cy", F.when(F.col("class_number") < 11, F.col("class_number")).alias("expected"))
    return boxes.verdicts(subjects, b.filter("kind = 'varietal'").select("photo", "ord", "cx", "cy", "class_number"), "photo")


@query(f"""WITH RECURSIVE {_BOXES}, o AS (SELECT photo, c, cx - 0.01 AS x, cy - 0.01 AS y, row_number() OVER (PARTITION BY photo, c ORDER BY ord, cx, cy) AS k FROM b),
f AS (SELECT DISTINCT photo, c, 0::BIGINT AS k, []::STRUCT(x DOUBLE, y DOUBLE)[] AS m FROM o UNION ALL
 SELECT f.photo, f.c, o.k, CASE WHEN len(list_filter(m, lambda q: sqrt(pow(q.x - o.x, 2) + pow(q.y - o.y, 2)) <= 0.04 OR
  greatest(0, least(q.x, o.x) + 0.02 - greatest(q.x, o.x)) * greatest(0, least(q.y, o.y) + 0.02 - greatest(q.y, o.y)) >= 0.5 * (0.0008 - greatest(0, least(q.x, o.x) + 0.02 - greatest(q.x, o.x)) * greatest(0, least(q.y, o.y) + 0.02 - greatest(q.y, o.y))))) > 0
  THEN m ELSE list_append(m, {{'x': o.x, 'y': o.y}}) END FROM f JOIN o ON o.photo = f.photo AND o.c = f.c AND o.k = f.k + 1),
g AS (SELECT photo, c, len(max_by(m, k)) AS n FROM f GROUP BY ALL) SELECT photo, CAST(sum(n) AS BIGINT) AS kept FROM g GROUP BY photo""")
def box_suppression(spark, sf_dir):
    b = ad.photo_boxes(spark, sf_dir).withColumns({"x": F.col("cx") - 0.01, "y": F.col("cy") - 0.01})
    return boxes.suppressed(b, "photo").groupBy("photo").agg(F.count("*").alias("kept"))


@query("""WITH b AS (SELECT l_orderkey AS photo, l_suppkey % 12 + 1 AS c, max_by(l_linenumber, (l_quantity, -l_linenumber)) AS ord, count(*) - 1 AS dropped FROM lineitem GROUP BY ALL)
SELECT photo, concat(CAST(c AS VARCHAR), 'T') AS subject_id, ord, dropped FROM b""")
def box_collapse(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("photo"), F.concat((F.col("l_suppkey") % 12 + 1).cast("string"), F.lit("T")).alias("subject_id"), F.col("l_linenumber").alias("ord"),
        F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("l_quantity").alias("w"), F.lit(1.0).alias("h"),
    )
    return boxes.collapsed(li, "photo").select("photo", "subject_id", "ord", "dropped")


# ---- similarity


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM e),
m AS (SELECT label, p, avg(CAST(v AS DOUBLE)) AS v FROM x GROUP BY ALL), t AS (SELECT label, list(v ORDER BY p) AS t, sqrt(sum(v * v)) AS n FROM m GROUP BY label),
s AS (SELECT vec_id, t.label, round(list_dot_product(CAST(embedding AS DOUBLE[]), t.t) / n / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) AS score FROM e, t)
SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM s QUALIFY rank <= 3""")
def template_matches(spark, sf_dir):
    e = ad.table(spark, sf_dir, "embeddings")
    known = similarity.templates(e, "label", "embedding")
    return similarity.matches(e, "embedding", known, "label", "vec_id").select("vec_id", "label", "rank")


# ---- season


@query("""SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey ROWS UNBOUNDED PRECEDING) AS cumulative,
 min(l_shipdate) OVER (PARTITION BY l_partkey) AS first_harvest FROM lineitem""")
def running_harvest(spark, sf_dir):
    li = ad.table(spark, sf_dir, "lineitem").withColumn("_o", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"))
    out = season.running_harvest(li.withColumn("day", F.col("_o")), "l_partkey", "day", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "cumulative", F.col("first_harvest.l_shipdate").alias("first_harvest"))


@query("""WITH g AS (SELECT l_partkey AS part, sum(l_quantity) AS grams, CAST(50 + l_partkey % 60 AS INT) AS days, l_partkey % 5 AS peak, avg(l_discount) * 100 AS flavor FROM lineitem GROUP BY l_partkey),
s AS (SELECT part, CASE WHEN grams >= 1500 THEN 25 WHEN grams >= 1000 THEN 20 WHEN grams >= 500 THEN 15 WHEN grams >= 200 THEN 10 WHEN grams >= 50 THEN 5 ELSE 0 END
 + CASE WHEN days < 60 THEN 25 WHEN days < 70 THEN 20 WHEN days < 80 THEN 15 WHEN days < 90 THEN 10 WHEN days < 100 THEN 5 ELSE 0 END + [20, 16, 12, 6, 0][peak + 1]
 + CASE WHEN round(flavor, 6) >= 9 THEN 15 WHEN round(flavor, 6) >= 7 THEN 12 WHEN round(flavor, 6) >= 5 THEN 8 WHEN round(flavor, 6) >= 3 THEN 4 ELSE 0 END + 10 AS score FROM g)
SELECT part, CAST(score AS BIGINT) AS score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 65 THEN 'good' WHEN score >= 45 THEN 'fair' ELSE 'poor' END AS tier FROM s""")
def season_scores(spark, sf_dir):
    g = ad.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.sum("l_quantity").alias("grams"), (F.avg("l_discount") * 100).alias("flavor"))
    s = season.season_score(F.col("grams"), (50 + F.col("part") % 60).cast("int"), F.col("part") % 5, F.round("flavor", 6), F.lit(10), F.lit(False)).cast("long")
    return g.select("part", s.alias("score")).withColumn("tier", season.tier(F.col("score")))


@query("""WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, sum(o_totalprice) AS v FROM orders GROUP BY 1), f AS (SELECT week_start, date_diff('day', DATE '1990-01-01', week_start) % 5 AS fog FROM w)
SELECT count(*) AS weeks, round(corr(v, fog), 9) AS correlation FROM w JOIN f USING (week_start)""")
def weekly_weather(spark, sf_dir):
    o = ad.table(spark, sf_dir, "orders")
    days = o.select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("week_start")).distinct()
    weather = days.withColumn("fog", F.datediff("week_start", F.lit("1990-01-01").cast("date")) % 5)
    return season.weekly_weather(o, weather, "o_orderdate", "o_totalprice", "fog").select("weeks", F.round("correlation", 9).alias("correlation"))
