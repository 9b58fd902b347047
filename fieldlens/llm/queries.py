"""The corpus operators and the pipeline over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, dialogue, jaccard, langid, licenses, media, mixing, pst, quality, secrets, sharding, urlfilter
from .common import read_table as read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs.withColumn("held_out", langid.fold(F.col("doc_id"), 5) == 0), net, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_by_bytes(read(spark, sf_dir, "documents"), shards=40)
    return sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = langid.fold(F.col("doc_id"), 7) == 2
    scored = pst.score_texts(docs.withColumn("held_out", held), F.col("held_out"), keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", langid.fold(F.col("doc_id"), 5) == 0)
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.identify(docs, model, keep=["doc_id", "held_out"])


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(read(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.text_to_media(read(spark, sf_dir, "documents"), keep=["doc_id"])
    found = media.media_features(stored, keep=["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    judged = urlfilter.filter_urls(pages, urlfilter.domain_rules(spark), urlfilter.pattern_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("places")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.Repair(dialogue.damage(read(spark, sf_dir, "conversations"))).summary()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mixing, op2_quality, op3_sharding, op4_decontamination, op5_lm_scoring, op6_language_id, op7_jaccard_join, op8_secret_scan, op9_media, op10_url_filter, op11_collocations, op12_license_scan, op13_conversation_repair)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


_URL_SQL = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages),
rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT p.*, (SELECT max_by({'rule': r_host || r_path, 'verdict': r_verdict}, length(r_host || r_path)) FROM rules
    WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)) AS b
  FROM parts p)
SELECT page_id, host, path, b.rule AS rule,
  CASE WHEN b IS NOT NULL THEN b.verdict
       WHEN regexp_matches(low, '(^|[/.-])free-bets[./-]') OR regexp_matches(low, '(^|[/.-])casino[./-]')
         OR regexp_matches(low, '(^|[/.-])(xxx|porn)[a-z0-9]*[./-]') OR regexp_matches(low, '[?&]utm_source=spam(&|#|\z)')
         OR regexp_matches(low, '\.(exe|apk|msi)([?#]|\z)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM best
"""

_DECONTAM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS k
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT uid, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT uid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.uid, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
words AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT uid, i, k FROM hit)) GROUP BY uid),
items AS (SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT uid, item FROM hit) GROUP BY uid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (uid) LEFT JOIN items USING (uid)
"""


_COLLOCATION_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM s)),
f1 AS (SELECT lang, x, count(*) AS n FROM g GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS n FROM g WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, x, y, z, count(*) AS n FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
sizes AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, 1 AS k, f2.n AS a, p.n AS l, q.n AS r
  FROM f2 JOIN f1 AS p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 AS q ON q.lang = f2.lang AND q.x = f2.y
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, 1, f3.n, p.n, q.n
  FROM f3 JOIN f1 AS p ON p.lang = f3.lang AND p.x = f3.x JOIN f2 AS q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, 2, f3.n, p.n, q.n
  FROM f3 JOIN f2 AS p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y JOIN f1 AS q ON q.lang = f3.lang AND q.x = f3.z),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, x || ' ' || y AS phrase, max(n) AS n FROM (SELECT lang, x, y, n FROM f3 UNION ALL SELECT lang, y, z, n FROM f3) GROUP BY ALL),
ranked AS (SELECT best.lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer.n IS NULL OR 100 * longer.n < 50 * a)
SELECT lang, rank, phrase, a, l, r, sizes.n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


def _license_sql() -> str:
    """All words that stand where a notice has them, counted for each place at which the notice would begin."""
    rows = [(t, label, base, p, w, p in must, len(words)) for t, (label, base, words, must) in enumerate(licenses.library()) for p, w in enumerate(words)]
    values = ", ".join(f"({t}, '{label}', {base}, {p}, '{w}', {must}, {size})" for t, label, base, p, w, must, size in rows)
    return r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
n(t, label, base, p, word, must, size) AS (VALUES {values}),
e AS (SELECT uid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
hit AS (SELECT uid, t, label, base, size, i - p AS start, count(*) AS agree, count_if(must) AS met FROM e JOIN n USING (word) GROUP BY ALL),
ok AS (SELECT uid, label, base, start, agree / size AS share FROM hit
  WHERE agree * 100 >= size * {share} AND met = (SELECT count_if(must) FROM n WHERE n.t = hit.t)),
per AS (SELECT uid, count_if(base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM ok GROUP BY uid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN per USING (uid)
""".replace("{values}", values).replace("{share}", str(licenses.SHARE))


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": _DECONTAM_SQL, "op10_url_filter": _URL_SQL, "op11_collocations": _COLLOCATION_SQL, "op12_license_scan": _license_sql()}
