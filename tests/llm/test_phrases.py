"""Collocations and licences against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlens.llm import collocations, licenses


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain_collocations(rows, least, first):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang][words[i : i + k]] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), a, left, right))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(ranked)[:first], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rng = np.random.default_rng(2)
    words = ["the", "The", "of", "Été", "été", "x-ray", "a", "b", "c", "d e", "中文"]
    rows = [(("en", "fr", None)[rng.integers(3)], "".join(words[i] + (" ", "  ", "\t", ". ", "\n", "-- ")[rng.integers(6)] for i in rng.integers(0, len(words), rng.integers(0, 60)))) for _ in range(80)]
    return rows + [("en", None), ("en", ""), ("en", " .,;"), ("und", "a b a b")] + [("fr", "one hot line of text")] * 60 + [("en", "a b c " * 4000)]


def test_collocations_equal_plain_counts(spark, talk):
    docs = spark.createDataFrame([(lang, text, "z", i) for i, (lang, text) in enumerate(talk)], "lang string, text string, phrase string, A long").repartition(4)
    got = lambda **k: sorted(tuple(r) for r in collocations.collocations(docs, **k).collect())
    assert got(least=3) == plain_collocations(talk, 3, 2000)
    assert got(least=10, first=5, block=7) == plain_collocations(talk, 10, 5)
    assert collocations.collocations(docs.filter("false")).count() == 0 and collocations.collocations(docs, least=10**6).count() == 0


def test_trie_finds_each_phrase_and_no_other():
    rng = np.random.default_rng(1)
    hot = np.stack([np.full(5000, 7, np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 4, 5000).astype(np.uint64)])
    few = rng.integers(0, 50, (3, 3000)).astype(np.uint64)
    phrases = np.unique(np.concatenate([hot, few], axis=1), axis=1)
    trie = collocations.Trie(phrases)
    text = np.concatenate([phrases.T.ravel(), rng.integers(0, 50, 20_000).astype(np.uint64)])
    follows = rng.integers(0, 9, len(text)) > 0
    follows[: phrases.size] = True
    follows[-1] = False
    known = {tuple(p) for p in phrases.T.tolist()}
    want = Counter(p for i in range(len(text) - 2) if follows[i] and follows[i + 1] and (p := tuple(text[i : i + 3].tolist())) in known)
    states, n = np.unique(trie.accepted(text, follows), return_counts=True)
    assert dict(zip(map(tuple, trie.phrases(states).T.tolist()), n.tolist())) == want
    assert len(collocations.Trie(np.zeros((2, 0), np.uint64)).accepted(text, follows)) == 0


def test_bitmap_lets_every_key_in(spark):
    keys = spark.range(5000).select((F.col("id") * 1234567890123 - 77).alias("key"))
    bits = collocations.bitmap(keys, 5000)
    own = np.array([r["key"] for r in keys.collect()], np.int64).view(np.uint64)
    assert collocations.has_bit(bits, own).all() and collocations.has_bit(bits, own + np.uint64(1)).mean() < 0.01


def plain_licenses(text, notices, share):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    found = []
    for label, base, own, must in notices:
        for start in range(-len(own), len(words)):
            stands = [0 <= start + p < len(words) and words[start + p] == w for p, w in enumerate(own)]
            if all(stands[p] for p in must) and sum(stands) * 100 >= len(own) * share:
                found.append((start, label, base, sum(stands) / len(own)))
    base = [s for s, _, b, _ in found if b]
    name = lambda rows: ",".join(sorted({x[1] for x in rows}))
    return len(words), len(base), min(base, default=None), max(base, default=None), name([x for x in found if x[2]]), name(found), max((x[3] for x in found), default=0.0)


MIT = licenses.NOTICES[12][1]
TEXTS = [
    None, "", "MIT License", "mit  LICENSE, Apache-License; the GNU General Public License version 3", "Released under the MİT License. Kelvin mit K license", MIT, MIT.replace("charge", "cost").replace("software", "thing", 1),
    " ".join(w if i % 4 else "zzz" for i, w in enumerate(MIT.split())), "under the apache license version 2 0", "licensed under the apache license version 2", "Licensed under CC BY-NC 4.0. " * 300 + "MIT license mit license " * 200,
    "license mit", "general public", "x" * 100_000 + " mit license", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "all rights reserved all rights reserved", "中文 mit license é",
]


def test_licenses_equal_plain_search(spark):
    notices = licenses.library()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id int, text string, LABELS int, places string").repartition(3)
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted((tuple(r) for r in licenses.scan_licenses(docs).select(columns).collect()), key=str)
    want = sorted(((i, *plain_licenses(t, notices, licenses.SHARE)) for i, t in enumerate(TEXTS) for _ in range(2)), key=str)
    assert got == want
    assert licenses.scan_licenses(docs.filter("false")).count() == 0 and licenses.scan_licenses(docs).columns[-1] == "places"


def test_the_index_keeps_two_places_of_every_altered_notice():
    rng = np.random.default_rng(4)
    for n in range(1, 60):
        k = licenses.anchors(n)
        assert n == 1 or n - k <= -(-n * licenses.SHARE // 100) - 2
    index = licenses.rare_index(licenses.library(), {"mit": 3, "license": 9})
    assert index["mit"] and all(rng.integers(2) < 2 for _ in index)
