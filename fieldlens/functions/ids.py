"""Ids and numbers out of free text: Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The text patterns of ids, in the order in which they are tried.
SUBJECT_PATTERNS = (r"(?i)\bpot[_\s-]*tag\s*=\s*([a-z0-9_-]+)\b", r"(?i)\b([0-9]{1,3})\s*t\b", r"(?i)\btomato[_\s-]*([0-9]{1,3})\b")
CLASS_PATTERNS = (r"(?i)\bpacket[_\s-]*tag\s*=\s*([a-z0-9_-]+)\b", r"(?i)\bpacket[_\s-]*([0-9]{1,3})\b")
TRUTHY = ("1", "true", "yes", "y", "on")
#: Words may be parted by _, - or white space; ids in a list need no word edges.
EXCLUDES = r"(?i)\bexclude[_\s-]*row\b|\bduplicate[_\s-]*of[_\s-]*row\b"
MISSING_LIST = r"(?i)\bmissing[_\s-]*pots?\s*[:=]\s*([^\n;]+)"
MISSING_ID = r"(?i)[0-9]{1,3}\s*T?"
MISSING_ONE = r"(?i)\bmissing\s+([0-9]{1,3}\s*T?)\b"
NUMBERS = r"\b([0-9]{1,3})\b"


def strip(c: Column) -> Column:
    """The text without white space at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def subject_id(c: Column, mode: str = "strict") -> Column:
    """`nT` without leading zeros, or null. strict: up to three digits, T optional; loose: any digits; tagged: T required."""
    body = {"strict": r"^[0-9]{1,3}T?$", "loose": r"^[0-9]+T?$", "tagged": r"^[0-9]+T$"}[mode]
    text = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    number = F.regexp_replace(text, "T$", "").try_cast("bigint")
    return F.when(text.rlike(body) & (number > 0), F.concat(number.cast("string"), F.lit("T")))


def subject_number(c: Column) -> Column:
    return F.regexp_extract(c, r"^([0-9]+)T$", 1).try_cast("bigint")


def class_number(c: Column) -> Column:
    number = F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")
    return F.when(number > 0, number)


def truthy(c: Column, on: bool = True) -> Column:
    words = TRUTHY if on else TRUTHY[:-1]
    return F.coalesce(F.lower(strip(c)).isin(*words), F.lit(False))


def safe_int(c: Column) -> Column:
    return F.coalesce(strip(c).try_cast("bigint"), F.lit(0))


def safe_double(c: Column) -> Column:
    return strip(c).try_cast("double")


def canonical_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def token(c: Column, fallback: str) -> Column:
    """Signs other than letters, digits, - and _ become _; nothing left gives the fallback."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(strip(c), "[^A-Za-z0-9_-]", "_"), F.lit("_")), F.lit("")), F.lit(fallback))


def _first(texts: list[Column], patterns: tuple[str, ...], norm, tag: Column | None) -> Column:
    """The first valid id: pattern by pattern, text by text, only the first match of a text counts."""
    tries = [norm(tag)] if tag is not None else []
    for p in patterns:
        tries += [norm(F.nullif(F.regexp_extract(t, p, 1), F.lit(""))) for t in texts]
    return F.coalesce(*tries)


def first_subject_id(*texts: Column) -> Column:
    return _first(list(texts), SUBJECT_PATTERNS, subject_id, None)


def first_class_number(*texts: Column) -> Column:
    return _first(list(texts), CLASS_PATTERNS, class_number, None)


def number_candidates(*texts: Column, most: int | None = None) -> Column:
    """Distinct numbers > 0 of one to three digits that stand alone, in order of appearance over the texts."""
    each = [F.coalesce(F.regexp_extract_all(t, F.lit(NUMBERS), F.lit(1)), F.array().cast("array<string>")) for t in texts]
    numbers = F.transform(F.concat(*each), lambda x: x.cast("bigint"))
    return F.array_distinct(F.filter(numbers, lambda x: (x > 0) & (x <= most) if most else x > 0))


def excludes_row(notes: Column) -> Column:
    """A note asks to drop the row. The bare words count even in `exclude_row=0`."""
    return F.coalesce(notes.rlike(EXCLUDES), F.lit(False))


def declared_missing(notes: Column) -> Column:
    """Sorted distinct subject ids that a note declares missing."""
    lists = F.regexp_extract_all(notes, F.lit(MISSING_LIST), F.lit(1))
    inside = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(MISSING_ID), F.lit(0))))
    bare = F.regexp_extract_all(notes, F.lit(MISSING_ONE), F.lit(1))
    found = F.transform(F.concat(inside, bare), lambda x: subject_id(x))
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(found))), F.array().cast("array<string>"))


def number_list(c: Column) -> Column:
    """Distinct positive numbers of a comma list."""
    return F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("bigint")), lambda x: x > 0))
