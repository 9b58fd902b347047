"""URL filter: pattern rules are indexed by their rarest literal token, URLs fetch candidates by token, and only the
candidates run their regular expressions. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, places_up_to, scratch

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: The domain rules of the contract as (host, path, verdict).
DOMAIN_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

#: Patterns on the lower-cased URL, each with a literal text that every match contains. The literal's edges are edges of
#: words in the URL, but for a last word with a star, which begins a word.
BLOCK_PATTERNS = [
    (r"(^|[/.-])free-bets[./-]", "free-bets"),
    (r"(^|[/.-])casino[./-]", "casino"),
    (r"(^|[/.-])xxx[a-z0-9]*[./-]", "xxx*"),
    (r"(^|[/.-])porn[a-z0-9]*[./-]", "porn*"),
    (r"[?&]utm_source=spam(&|#|\z)", "utm_source=spam"),
    (r"\.exe([?#]|\z)", "exe"),
    (r"\.apk([?#]|\z)", "apk"),
    (r"\.msi([?#]|\z)", "msi"),
]
#: Letters of a word by which rules for beginnings of words are found.
BEGINNING = 3


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a literal VALUES clause."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    if not rows:
        return spark.createDataFrame([], schema)
    text = ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows)
    table = spark.sql(f"SELECT * FROM VALUES {text} AS t({names})")
    return table.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")))


def domain_rules(spark: SparkSession, rules: list[tuple[str, str, str]] = DOMAIN_RULES) -> DataFrame:
    """Rules (rule, literal, regex, verdict, rank): host and subdomains, path prefix; longer rules rank higher."""
    escape = lambda s: "".join(c if c.isalnum() or c in "/-_" else "\\" + c for c in s)
    whole = lambda h, p: h + "/" + p.rstrip(string.ascii_letters + string.digits)  # noqa: E731  the last word of a path may go on in a URL
    rows = [(h + p, whole(h, p), rf"^([^/]*\.)?{escape(h)}{escape(p)}", v, len(h + p)) for h, p, v in rules]
    return _values(spark, rows, "rule string, literal string, regex string, verdict string, rank int")


def pattern_rules(spark: SparkSession, patterns: list[tuple[str, str]] = BLOCK_PATTERNS) -> DataFrame:
    rows = [(None, lit, regex, "block", 0) for regex, lit in patterns]
    return _values(spark, rows, "rule string, literal string, regex string, verdict string, rank int")


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.filter(F.split(low, "[^a-z0-9*]+"), lambda w: w != ""))


def tokens(url: Column) -> Column:
    """The distinct words of a URL (runs of ASCII letters and digits, lower-cased), and their beginnings with a star."""
    words = _words(F.translate(url, "*", " "))
    return F.array_distinct(F.concat(words, F.transform(words, lambda w: F.concat(F.substring(w, 1, BEGINNING), F.lit("*")))))


def literal_tokens(literal: Column) -> Column:
    """The tokens of which every URL with the literal has all; a rule without any has the empty one."""
    begins = lambda w: F.concat(F.substring(F.translate(w, "*", ""), 1, BEGINNING), F.lit("*"))
    words = F.transform(_words(literal), lambda w: F.when(w.endswith("*"), begins(w)).otherwise(w))
    # a beginning that is too short finds nothing
    words = F.filter(words, lambda w: ~w.endswith("*") | (F.length(w) > BEGINNING))
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("")))


def rule_index(rules: DataFrame, urls: DataFrame, url: str, broadcast_rules: int) -> DataFrame:
    """Each rule with the token of its literal that the fewest URLs hold.

    Only the words of the rules' literals are counted over the URLs.
    """
    spread = rules.withColumn("token", F.explode(literal_tokens(F.col("literal"))))
    wanted = spread.select("token").distinct()
    small = rules.count() <= broadcast_rules
    each = urls.select(F.explode(tokens(F.col(f"`{url}`"))).alias("token"))
    seen = each.join(F.broadcast(wanted) if small else wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = spread.join(seen, "token", "left").withColumn("order", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    keys = ["rule", "literal", "regex", "verdict", "rank"]
    return ranked.groupBy(*keys).agg(F.min_by("token", "order").alias("token"))


def filter_urls(pages: DataFrame, domain: DataFrame, patterns: DataFrame, url: str = "url", broadcast_rules: int = 50_000) -> DataFrame:
    """pages with host, path, rule and verdict.

    The longest domain rule that fits decides; ties go to the smaller rule text, then to `allow`. Without one,
    `block` if a pattern matches the lower-cased URL, else `allow`. A null URL or one without `://` has an empty host
    and path and no rule; patterns still see a URL without `://`. Repeated rows stay. Columns of pages that clash with
    the new ones are replaced. No rows give no rows.

    Up to broadcast_rules rules (a few MB), the index is one broadcast row, arrays sorted by token, which each URL
    searches for its tokens in place, so its cost grows with the logarithm of the number of rules. More are joined with the URLs' tokens by shuffle.
    """
    new = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in new]
    names = {n: free_name(pages, n) for n in ("_uid", "_token", "_rules", "_index", "_sought", "_best", "_blocked")}
    base = pages.select(*(F.col(f"`{c}`") for c in kept), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    rule = F.struct((F.col("rule").isNotNull()).alias("on_key"), "rank", "rule", "verdict", "regex").alias("r")
    index = rule_index(domain.unionByName(patterns), pages, url, broadcast_rules).select("token", rule)
    index = index.groupBy("token").agg(F.array_sort(F.collect_list("r")).alias("rules"))
    if (n := domain.count() + patterns.count()) <= broadcast_rules:
        size = index.count()
        # tokens and rules stand in two columns, so that a step of the search reads one token and builds nothing
        whole = index.agg(F.array_sort(F.collect_list(F.struct("token", "rules"))).alias("i"))
        whole = whole.select(F.transform("i", lambda e: e["token"]).alias(names["_sought"]), F.transform("i", lambda e: e["rules"]).alias(names["_index"]))
        found = base.join(F.broadcast(whole), F.lit(True))

        def rules_of(token):
            at = places_up_to(F.col(names["_sought"]), size, token) - 1
            return F.when(F.get(F.col(names["_sought"]), at) == token, F.get(F.col(names["_index"]), at))

        sought = F.concat(tokens(F.col(f"`{url}`")), F.array(F.lit("")))
        found = found.withColumn(names["_rules"], F.flatten(F.filter(F.transform(sought, rules_of), lambda e: e.isNotNull()))).drop(names["_index"], names["_sought"])
    else:
        # the URLs' rows are stored, so that a row has the same number wherever it is read
        base = scratch(base.withColumn(names["_uid"], F.monotonically_increasing_id()), f"url-rows-{n}")
        each = base.select(names["_uid"], F.explode(F.concat(tokens(F.col(f"`{url}`")), F.array(F.lit("")))).alias("token"))
        per = each.join(index, "token").groupBy(names["_uid"]).agg(F.flatten(F.collect_list("rules")).alias(names["_rules"]))
        found = base.join(per, names["_uid"], "left").drop(names["_uid"])
    key, low = F.concat("host", "path"), F.translate(F.coalesce(F.col(f"`{url}`"), F.lit("")), UPPER, LOWER)
    fits = lambda r: F.when(r["on_key"], (F.col("host") != "") & F.rlike(key, r["regex"])).otherwise(F.rlike(low, r["regex"]))
    met = F.filter(F.coalesce(F.col(names["_rules"]), F.array()), fits)
    longest = lambda r: F.struct(r["rank"].alias("rank"), (r["verdict"] == "allow").alias("allow"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))
    found = found.withColumn(names["_rules"], met)
    best = F.array_max(F.transform(F.filter(names["_rules"], lambda r: r["on_key"]), longest))
    found = found.withColumn(names["_best"], best).withColumn(names["_blocked"], F.exists(names["_rules"], lambda r: ~r["on_key"]))
    return found.select(
        *(F.col(f"`{c}`") for c in kept),
        "host",
        "path",
        F.col(names["_best"])["rule"].alias("rule"),
        F.coalesce(F.col(names["_best"])["verdict"], F.when(F.col(names["_blocked"]), "block").otherwise("allow")).alias("verdict"),
    )
