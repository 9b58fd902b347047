"""Licence scan: a positional index of rare licence words. DataFrame functions only.

Each notice registers those of its places whose words the fewest documents hold. A file's indexed words fetch (notice,
place) postings; postings that agree on where the notice would begin are intersected, and a beginning that two of them
share is verified: the mandatory key phrases stand at their places, and enough of the notice's words at theirs. A notice
with t words and at most t * (1 - share) changed words keeps two of its rarest ones if t * (1 - share) + 2 are indexed,
so the index loses nothing.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import places_up_to

#: The base phrases of the contract, whose words are all mandatory.
BASE_PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]

#: Notices as (label, words, mandatory phrases), lower-cased and without signs.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["except in compliance with the license"],
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "with or without modification"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ["permission is hereby granted", "without restriction"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]

#: The part of a notice's words that must stand at their places, in hundredths.
SHARE = 80
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased as far as ASCII words go: the Kelvin sign, the one sign whose lower case is
    an ASCII letter alone, is replaced by a letter that is none."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("K"), F.lit("ĸ"))), F.lit(WORD), F.lit(0))


def _notice(label: str, text: str, keys: list[str], base: bool) -> tuple:
    """(label, base, words, places that must agree)."""
    words, must = text.split(), set()
    for key in (k.split() for k in keys):
        at = [i for i in range(len(words)) if words[i : i + len(key)] == key]
        if not at:
            raise ValueError(f"a mandatory phrase is not in its notice: {' '.join(key)}")
        must.update(at[0] + j for j in range(len(key)))
    return label, base, words, sorted(must)


def library(notices: list[tuple[str, str, list[str]]] = NOTICES, base: list[tuple[str, str]] = BASE_PHRASES) -> list[tuple]:
    return [_notice(label, text, [text], True) for label, text in base] + [_notice(label, text, keys, False) for label, text, keys in notices]


def anchors(n_words: int, share: int = SHARE) -> int:
    """How many places of a notice are indexed, so that two are left where `share` hundredths of its words stand."""
    return min(n_words, n_words - math.ceil(n_words * share / 100) + 2)


def document_counts(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """In how many documents each word of the vocabulary stands; counted over all, at most a number for each word is returned."""
    held = F.array_intersect(words_of(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.array(*(F.lit(w) for w in vocabulary)))
    return {r["w"]: r["n"] for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}


def rare_index(notices: list[tuple], counts: dict[str, int], share: int = SHARE) -> dict[str, list[tuple[int, int]]]:
    """Postings (notice, place) of each indexed word: of each notice the places of highest inverse document frequency, that
    is of the fewest documents; ties to the earlier place."""
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (_, _, words, _) in enumerate(notices):
        for p in sorted(range(len(words)), key=lambda p: (counts.get(words[p], 0), p))[: anchors(len(words), share)]:
            index.setdefault(words[p], []).append((t, p))
    return index


def scan_licenses(docs: DataFrame, notices: list[tuple] | None = None, share: int = SHARE, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word, base_labels, labels, score and places.

    places: (start, words, label, base, share) of each verified notice, a start before the text being negative. Base
    phrases count where all their words stand; first_word and last_word are their least and greatest start (null without
    any). score is the greatest share of a notice's words at its place, 0 without one. Null and empty texts have no words.
    Repeated rows are scanned each, no rows give no rows, and columns of docs that clash with new ones are replaced.
    Every row is judged alone, without a shuffle; a first pass counts in how many documents the notices' words stand.
    """
    notices = notices or library()
    vocabulary = sorted({w for _, _, words, _ in notices for w in words})
    index = rare_index(notices, document_counts(docs, vocabulary, text), share)
    sought = sorted(index, key=lambda w: w.encode())

    new = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"}
    kept = [c for c in docs.columns if c.lower() not in new and c != text]
    spark = docs.sparkSession
    postings = [[{"t": t, "p": p} for t, p in index[w]] for w in sought]
    told = [{"label": label, "base": base, "words": words, "must": must} for label, base, words, must in notices]
    # one row, told as JSON so that nothing of it starts Python
    whole = spark.range(1).select(*(F.from_json(F.lit(json.dumps(v)), kind).alias(name) for name, (v, kind) in {
        "_sought": (sought, "array<string>"),
        "_postings": (postings, "array<array<struct<t:int,p:int>>>"),
        "_notices": (told, "array<struct<label:string,base:boolean,words:array<string>,must:array<int>>>"),
    }.items()))

    named = docs.select(*(F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(kept)), words_of(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_words"))
    found = named.withColumn("_hits", F.array_compact(F.transform("_words", lambda w, i: F.when(w.isin(sought), i))))
    found = found.join(F.broadcast(whole), F.lit(True))

    def begins(i):
        own = F.get(F.col("_postings"), places_up_to(F.col("_sought"), len(sought), F.get(F.col("_words"), i)) - 1)
        return F.transform(own, lambda p: F.struct(p["t"].alias("t"), (i - p["p"]).alias("start")))

    found = found.withColumn("_begins", F.sort_array(F.flatten(F.transform("_hits", begins))))
    # the first of each run of two or more equal beginnings
    twice = F.filter("_begins", lambda b, k: (b == F.get(F.col("_begins"), k + 1)) & ((k == 0) | (b != F.get(F.col("_begins"), k - 1))))

    def verified(b):
        notice = F.get(F.col("_notices"), b["t"])
        stands = lambda p: F.coalesce(F.get(F.col("_words"), b["start"] + p) == F.get(notice["words"], p), F.lit(False))
        size = F.size(notice["words"])
        agree = F.size(F.filter(F.sequence(F.lit(0), size - 1), stands))
        fits = F.forall(notice["must"], stands) & (agree * 100 >= size * share)
        return F.when(fits, F.struct(b["start"].alias("start"), size.alias("words"), notice["label"].alias("label"), notice["base"].alias("base"), (agree / size).alias("share")))

    found = found.withColumn("_twice", twice).withColumn("places", F.array_compact(F.transform("_twice", verified)))
    base = F.filter("places", lambda x: x["base"])
    names = lambda places: F.array_join(F.sort_array(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")
    return found.select(
        *(F.col(f"_k{i}").alias(c) for i, c in enumerate(kept)),
        F.size("_words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).cast("long").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        "places",
    )
