"""Secret scan with multipart credential linking. DataFrame functions only.

Strong findings (`assign`, `access`, `hex`) are reported as they stand. Weak candidates are parts of credentials that
mean nothing alone: `ident` (a user or client name), `blob` (a run of 40 base64 signs) and `endpoint` (a URL's scheme
and host). An interval join within scopes reports them only where their complements stand near by: a blob beside an
identifier, an ident beside a secret, an endpoint beside both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, scratch


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The patterns of the contract, group 2 of ASSIGN being the value.
ASSIGN = "(" + "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

IDENT = "(?:" + "|".join(_any_case(w) for w in ("username", "login", "client_id", "account_id", "user_id")) + r""")["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9_.@-]{3,64}"""
BLOB = "(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"[a-z]{2,10}://[A-Za-z0-9.-]{3,255}"

KINDS = ("assign", "access", "hex", "ident", "blob", "endpoint")
IDENTIFIER, SECRET, PLACE = "identifier", "secret", "place"
ROLE = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "ident": IDENTIFIER, "blob": SECRET, "endpoint": PLACE}
#: The roles that must stand near a weak candidate.
NEEDS = {"ident": [SECRET], "blob": [IDENTIFIER], "endpoint": [IDENTIFIER, SECRET]}
SPANS = "array<struct<start:int,rank:int,end:int>>"


#: Matches whose places are added up in one fold; a fold copies what it has found, so longer ones are cut.
FOLDED = 128


def _spans(text: Column, kind: str, pattern: str, may: Column, fits) -> Column:
    """Spans of a pattern's matches in code points: lengths of the pieces between matches and of the matches add up.

    Sums run within stretches of FOLDED matches, and the stretches' own sums move them to their places.
    """
    rank = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), fits(h).alias("fits")))
    empty = F.array().cast(SPANS)

    def step(acc, pair):
        begin = acc["at"] + pair["gap"]
        end = begin + pair["len"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(pair["fits"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def stretch(k):
        return F.aggregate(F.slice(pairs, k * FOLDED + 1, FOLDED), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def move(acc, part):
        moved = F.transform(part["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["rank"].alias("rank"), (s["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / FOLDED).cast("int")), stretch)
    nested = F.array().cast(f"array<{SPANS}>")
    whole = F.aggregate(parts, F.struct(F.lit(0).alias("at"), nested.alias("out")), move, lambda a: F.flatten(a["out"]))
    return F.when(may & (F.size(found) > 0), whole).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Matches of the three strong patterns; ACCESS and HEX cannot match less than a whole run, so runs that are too
    short need not be looked at."""
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_VALUE
    true = lambda hit: F.lit(True)
    sign = text.contains("=") | text.contains(":")
    return F.concat(
        _spans(text, "assign", ASSIGN, sign & text.rlike(ASSIGN), value),
        _spans(text, "access", f"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}", text.contains("AKIA"), true),
        _spans(text, "hex", f"[0-9a-f]{{{HEX_LENGTH},}}", text.rlike(f"[0-9a-f]{{{HEX_LENGTH}}}"), true),
    )


def weak_spans(text: Column) -> Column:
    true = lambda hit: F.lit(True)
    return F.concat(
        _spans(text, "ident", IDENT, (text.contains("=") | text.contains(":")) & text.rlike(IDENT), true),
        _spans(text, "blob", BLOB, text.rlike("[A-Za-z0-9+/]{40}"), true),
        _spans(text, "endpoint", ENDPOINT, text.contains("://"), true),
    )


def _code(spans: Column) -> Column:
    """kind:start:end of each span, by start, kind and end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def linked_weak(parts: DataFrame, reach: int) -> DataFrame:
    """(uid, spans): the weak candidates with all their complements within reach.

    parts: (uid, start, rank, end). Two parts are near if the gap between them is at most `reach` code points. Both
    sides of the interval join are laid out over cells of the text, one cell reaching as far as any part and gap, and
    a left semi join keeps a candidate once, whatever the number of its complements.
    """
    cell = reach + 512
    role = F.get(F.array(*(F.lit(ROLE[k]) for k in KINDS)), F.col("rank"))
    at = F.floor(F.col("start") / cell)
    every = parts.withColumn("role", role)
    weak = every.filter(F.col("rank") >= KINDS.index("ident")).withColumn("cell", at)
    # a long strong span is laid into each cell that it touches or that is next to one
    side = every.select(
        F.col("uid").alias("c_uid"),
        F.explode(F.sequence(at - 1, F.floor(F.col("end") / cell) + 1)).alias("c_cell"),
        F.col("start").alias("c_start"),
        F.col("end").alias("c_end"),
        F.col("role").alias("c_role"),
    )
    kept = None
    for kind, needs in NEEDS.items():
        mine = weak.filter(F.col("rank") == KINDS.index(kind))
        for need in needs:
            near = (
                (F.col("uid") == F.col("c_uid"))
                & (F.col("cell") == F.col("c_cell"))
                & (F.col("c_start") <= F.col("end") + reach)
                & (F.col("start") <= F.col("c_end") + reach)
            )
            mine = mine.join(side.filter(F.col("c_role") == need), near, "left_semi")
        mine = mine.select("uid", F.struct("start", "rank", "end").alias("span"))
        kept = mine if kept is None else kept.unionByName(mine)
    return kept.groupBy("uid").agg(F.collect_list("span").alias("spans"))


def scan_secrets(docs: DataFrame, reach: int = 160, text: str = "text") -> DataFrame:
    """docs with base and weak findings as arrays (start, rank, end) and n_assign, n_access, n_hex, base_sha256, spans.

    Positions are code points from 0, ends exclusive. Strong matches are leftmost and do not overlap within a kind;
    weak ones may overlap strong ones. Null and empty texts have no findings. Repeated rows are scanned each; no rows
    give no rows; columns of docs that clash with new ones are replaced. The text is scanned once: the findings are
    written to the shared folder, and only rows with weak candidates are joined.
    """
    new = {"base_spans", "weak_spans", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}
    kept = [c for c in docs.columns if c.lower() not in new]
    uid = free_name(docs, "_uid")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.select(*(F.col(f"`{c}`") for c in kept if c != text), base_spans(body).alias("base_spans"), weak_spans(body).alias("weak_spans"))
    found = scratch(found.withColumn(uid, F.monotonically_increasing_id()), "secret-spans")
    parts = (
        found.filter(F.size("weak_spans") > 0)
        .select(F.col(uid).alias("uid"), F.explode(F.concat("base_spans", "weak_spans")).alias("s"))
        .select("uid", "s.start", "s.rank", "s.end")
    )
    linked = linked_weak(parts, reach).withColumnsRenamed({"uid": "_l_uid", "spans": "_l_spans"})
    alone = found.filter(F.size("weak_spans") == 0).withColumn("weak_spans", F.array().cast(SPANS))
    mixed = found.filter(F.size("weak_spans") > 0).join(linked, F.col(uid) == F.col("_l_uid"), "left")
    mixed = mixed.withColumn("weak_spans", F.coalesce("_l_spans", F.array().cast(SPANS))).drop("_l_uid", "_l_spans")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["rank"] == KINDS.index(k))).cast("long")
    return alone.unionByName(mixed).select(
        *(F.col(f"`{c}`") for c in kept if c != text),
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_code(F.col("base_spans")), 256).alias("base_sha256"),
        _code(F.concat("base_spans", "weak_spans")).alias("spans"),
        "base_spans",
        "weak_spans",
    )
