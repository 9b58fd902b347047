"""Row-local text, date and annotation expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import canonical_key, slug, strip

#: Names that stand for others, by canonical key.
ALIASES = {"bes yellow latvian": "Iles Yellow Latvian", "walmea wild cherry": "Waimea Wild Cherry"}

#: Ordered keyword rules (pattern, common name, scientific name, confidence).
SPECIES_RULES = [
    (r"\bcollard(s)?\b", "Collards", "Brassica oleracea var. viridis", 0.95),
    (r"\bbrassica\s+oleracea\b", "Collards", "Brassica oleracea", 0.95),
    (r"\bleek(s)?\b", "Leek", "Allium porrum", 0.95),
    (r"\ballium\s+porrum\b", "Leek", "Allium porrum", 0.95),
    (r"\bspinach\b", "Spinach", "Spinacia oleracea", 0.95),
    (r"\bspinacia\b", "Spinach", "Spinacia oleracea", 0.95),
    (r"\bkale\b", "Kale", "Brassica napus", 0.95),
    (r"\bbrassica\s+napus\b", "Kale", "Brassica napus", 0.95),
    (r"\bcabbage\b", "Red Cabbage", "Brassica oleracea var. capitata", 0.95),
    (r"\bchard\b", "Swiss Chard", "Beta vulgaris subsp. vulgaris", 0.9),
    (r"\bpea(s)?\b", "Pea", "Pisum sativum", 0.95),
    (r"\bpisum\b", "Pea", "Pisum sativum", 0.95),
    (r"\bturnip(s)?\b", "Turnip", "Brassica rapa subsp. rapa", 0.95),
    (r"\bbrassica\s+rapa\b", "Turnip", "Brassica rapa", 0.95),
    (r"\blettuce\b", "Lettuce", "Lactuca sativa", 0.95),
    (r"\bbasil\b", "Basil", "Ocimum basilicum", 0.95),
    (r"\bpepper(s)?\b", "Pepper", "Capsicum annuum", 0.9),
    (r"\bcucumber(s)?\b", "Cucumber", "Cucumis sativus", 0.95),
    (r"\bcilantro\b", "Cilantro", "Coriandrum sativum", 0.95),
    (r"\bparsley\b", "Parsley", "Petroselinum crispum", 0.95),
]

#: Words that name the target species or one of its varieties.
TARGET_PATTERNS = [
    r"\btomato(es)?\b", r"\bstupice\b", r"\bglacier\b", r"\bsiletz\b", r"\blegend\b", r"\bsungold\b", r"\bearly\s+girl\b", r"\bjuliet\b", r"\bblack\s+krim\b",
    r"\bsan\s+marzano\b", r"\bbrandywine\b", r"\bcherokee\s+purple\b", r"\bsunset\b", r"\btomatofest\b", r"\bheinz\b", r"\btrifel+e\b", r"\bjapanese\s+black\b",
    r"\bsan\s+francisco\s+fog\b", r"\bbes\s+yellow\s+latvian\b", r"\btaxi\b", r"\bnikolayev\s+yellow\s+cherry\b", r"\bsunset'?s\s+red\s+horizon\b",
    r"\bwalmea\s+wild\s+cherry\b", r"\bsasha\s+altai\b", r"\bazoychka\b", r"\bgold\s+dust\b",
]


def alias(name: Column) -> Column:
    """The replacement of a name by its canonical key, else the trimmed name; null for nothing."""
    key = canonical_key(name)
    return reduce(lambda out, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(out), ALIASES.items(), strip(name))


def caption_parts(caption: Column) -> Column:
    """struct(variety, plant, source, rest, reject) of `variety | plant | source | rest`."""
    parts = F.transform(F.split(caption, r"\|"), lambda x: F.trim(x))
    at = lambda i: F.nullif(F.try_element_at(parts, F.lit(i)), F.lit(""))
    bad = F.when(F.size(parts) < 3, "too_few_parts").when(at(1).isNull(), "no_variety").when(at(2).isNull(), "no_plant")
    rest = F.when(F.size(parts) > 3, F.array_join(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), " | "))
    return F.struct(at(1).alias("variety"), at(2).alias("plant"), F.coalesce(at(3), F.lit("unknown")).alias("source"), rest.alias("rest"), bad.alias("reject"))


def variety_name(explicit: Column, common: Column, caption: Column) -> Column:
    """Explicit name, else common name, of which `unknown` and `tomato` count for nothing, else the caption before its
    first pipe, whatever it says."""
    real = lambda c: F.when(~F.lower(strip(c)).isin("unknown", "tomato"), strip(c))
    return F.coalesce(real(explicit), real(common), strip(F.when(caption.contains("|"), F.substring_index(caption, "|", 1))))


def capture_date(explicit: Column, captured: Column, uploaded: Column) -> Column:
    """The date as the text says it, without any shift of zone."""
    day = lambda c: F.try_to_date(F.substring(strip(c), 1, 10), "yyyy-MM-dd")
    return F.coalesce(day(explicit), day(captured), day(uploaded))


def iso_local(ms: Column, offset_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms + F.coalesce(offset_ms, F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss")


def offset_text(offset_ms: Column) -> Column:
    minutes = F.floor(offset_ms / 60000)
    return F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)


def synthetic_id(row: Column, url: Column) -> Column:
    return F.concat(F.lit("manual_"), row.cast("string"), F.lit("_"), F.substring(F.sha1(F.coalesce(url, F.lit("")).cast("binary")), 1, 10))


def record_hash(*parts: Column) -> Column:
    return F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def needed_word(pattern: str) -> str:
    """The longest run of letters that any match of a rule's pattern has; nothing if its form does not tell."""
    plain = re.sub(r"\([^()]*\)[?*]", " ", re.sub(r"\\.", " ", pattern))
    if re.search(r"[|(){}\[\]]", plain):
        return ""
    return max(re.findall("[a-z]+", re.sub(r"[a-z][?*]", " ", plain)), key=len, default="")


def _matches(low: Column, patterns: list[str]) -> Column:
    """Any pattern matches. Words are looked for first, as that reads a text's bytes without decoding it for each pattern."""
    words = [needed_word(p) for p in patterns]
    found = low.rlike("|".join(patterns))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)) & found if all(words) else found


def classify_text(text: Column, targets: str = "|".join(TARGET_PATTERNS), rules: list = SPECIES_RULES) -> Column:
    """struct(label, common, scientific, confidence, method) of the first rule that matches; species before targets."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    make = lambda *v: F.struct(*(F.lit(x).cast(t).alias(n) for x, n, t in zip(v, ("label", "common", "scientific", "confidence", "method"), ("string",) * 3 + ("double", "string"))))
    out = F.when(F.trim(low) == "", make("unknown", None, None, 0.3, "ocr_no_text"))
    for pattern, common, scientific, sure in rules:
        out = out.when(_matches(low, [pattern]), make("non_tomato", common, scientific, sure, "ocr_keyword"))
    target = _matches(low, TARGET_PATTERNS) if targets == "|".join(TARGET_PATTERNS) else low.rlike(targets)
    return out.when(target, make("tomato", "Tomato", "Solanum lycopersicum", 0.9, "ocr_keyword")).otherwise(make("unknown", None, None, 0.4, "ocr_unresolved"))


#: How boxes are described. A class number has one to three digits, a subject id a T besides.
CLASS_TEXTS = (r"(?i)\bvariet(?:al)?\s*(?:no|number)?\s*([0-9]{1,3})\b", r"(?i)\b([0-9]{1,3})\s*variet(?:al)?\s*tag\b", r"(?i)\b([0-9]{1,3})\s*variet(?:al)?\b")
SUBJECT_TEXT = r"(?i)\b(?:tag\s*for\s*)?pot\s*([0-9]{1,3})\s*t\b"
BARE_SUBJECT_TEXT = r"(?i)\b([0-9]{1,3})\s*t\b"


def annotation_kind(description: Column) -> Column:
    """struct(kind, value) of a box's text. A class number keeps its text, a subject id drops zeros."""
    low = F.trim(F.coalesce(description, F.lit("")))
    get = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    varietal = F.coalesce(*(get(p) for p in CLASS_TEXTS))
    pot = F.coalesce(get(SUBJECT_TEXT), F.when(F.lower(low).contains("pot"), get(BARE_SUBJECT_TEXT)))
    made = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("value"))
    none = F.lit(None).cast("string")
    return (
        F.when(low == "", made("unlabeled", none))
        .when(varietal.isNotNull(), made("varietal", varietal))
        .when(pot.isNotNull(), made("pot", F.concat(pot.try_cast("bigint").cast("string"), F.lit("T"))))
        .otherwise(made("other", none))
    )


def level_kind(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike("label|number|stake"), "identity").when(low.rlike("plant|leaf|fruit"), "growth").when(low.rlike("background"), "noise").otherwise("review")


def confidence_percent(c: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(c.try_cast("double") * 100).cast("int"))), F.lit(0))


def delta_bucket(delta: Column) -> Column:
    return F.when(delta.isNull(), "unscored").when(delta >= 0.25, "strong").when(delta >= 0, "modest").when(delta <= -0.25, "stalled").otherwise("flat")


def note_join(*notes: Column) -> Column:
    return F.array_join(F.array_distinct(F.array_compact(F.array(*(strip(n) for n in notes)))), "; ")


def search_blob(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def task_key(prefix: str, rank: Column, subject: Column, asset: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), rank.cast("string"), F.nullif(F.lower(subject), F.lit("")), F.nullif(F.substring(F.lower(asset), 1, 12), F.lit("")))


def saved_at(*texts: Column) -> Column:
    """The first readable ISO time; one without zone is UTC."""
    return F.coalesce(*(F.try_to_timestamp(t) for t in texts))


def clamp_domain(c: Column, domain: list[str], default: str) -> Column:
    return F.when(strip(c).isin(*domain), strip(c)).otherwise(F.lit(default))


def is_subject_of_interest(caption: Column, keys: list[str]) -> Column:
    """The caption says `tomato` as a word, or what stands before its first pipe, or the whole, has a registry key as slug."""
    slugs = [F.when(caption.contains("|"), slug(F.trim(F.substring_index(caption, "|", 1)))), slug(F.trim(caption))]
    known = [s.isin(*keys) & (s != "") for s in slugs] if keys else [F.lit(False)]
    return reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), known, F.coalesce(caption.rlike(r"(?i)\btomato(es)?\b"), F.lit(False)))


def percent_text(c: Column, signed: bool = False) -> Column:
    """A share as percent with one decimal; null is `n/a`, or null where signs are asked for."""
    made = F.format_string("%.1f%%", c * 100)
    return F.when(c > 0, F.concat(F.lit("+"), made)).when(c.isNotNull(), made) if signed else F.coalesce(F.when(c.isNotNull(), made), F.lit("n/a"))


def low_domain(c: Column, domain: tuple[str, ...] = ("high", "moderate", "low"), default: str = "unknown") -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin(*domain), low).otherwise(F.lit(default))


def badge(status: Column) -> Column:
    return F.when(F.startswith(F.trim(status), F.lit("ready_")), "ready").otherwise("review")


def spoken(c: Column) -> Column:
    return F.coalesce(F.replace(strip(c), F.lit("_"), F.lit(" ")), F.lit("unknown"))
