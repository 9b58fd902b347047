"""Rules that look for words first, and boxes that are typed and read once."""

import re

from pyspark.sql import functions as F

from fieldlens.functions import text
from fieldlens.operators import boxes, report
from fieldlens.plans import catalog, records, worklists

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_that_rules_need():
    made = {p: text.needed_word(p) for p in (r"\bsunset'?s\s+red\b", r"\btrifel+e\b", r"\bcolou?r\b", r"\ba|b\b", r"\btomato(es)?\b", r"\b[ab]x\b")}
    assert made == {r"\bsunset'?s\s+red\b": "sunset", r"\btrifel+e\b": "trifel", r"\bcolou?r\b": "colo", r"\ba|b\b": "", r"\btomato(es)?\b": "tomato", r"\b[ab]x\b": ""}


def test_labels_are_those_of_the_patterns_alone(spark):
    says = ["Collards", "collardss", "brassica \n rapa", "Brassicarapa", "peas", "peanut", "SAN  Francisco fog", "trifellle", "trifele", "sunset's red horizon", "tomatoes", "tomatoe", "gold dust", "golden", "", " \t", None, "kale tomato"]
    got = [r.v.label for r in spark.createDataFrame([(i, s) for i, s in enumerate(says)], "i int, s string").select("i", text.classify_text(F.col("s")).alias("v")).orderBy("i").collect()]

    def plain(s):
        low = re.sub(r"\s+", " ", s or "").lower()
        if not low.strip(" "):
            return "unknown"
        return "non_tomato" if any(re.search(p, low) for p, *_ in text.SPECIES_RULES) else "tomato" if re.search("|".join(text.TARGET_PATTERNS), low) else "unknown"

    assert got == [plain(s) for s in says]
    assert "Contains(" in plan(catalog.text_labels(spark, SF))


def test_evidence_of_one_pass(spark):
    rows = [(1, 0, "pot", "5T"), (1, 1, "varietal", "07"), (1, 2, "pot", "6T"), (1, 3, "other", None), (1, 4, "varietal", "7"), (2, 0, "unlabeled", None), (3, 1, "pot", "1T"), (3, 3, "varietal", "2"), (1, 5, "pot", "5T"), (1, 6, "varietal", "7")]
    d = spark.createDataFrame(rows, "photo long, ord int, kind string, value string")
    got = {r.photo: (r.subjects, r.classes, [tuple(p) for p in r.pairs]) for r in boxes.evidence(d, "photo").collect()}
    assert got == {1: (["5T", "6T"], [7], [("5T", 7)]), 2: ([], [], []), 3: (["1T"], [2], [])}
    assert all("photo-evidence" in f or f.endswith("orders.parquet") for f in records.presence_audit(spark, SF).inputFiles())


def test_values_are_counted_without_expanding_rows(spark):
    assert "Expand" not in plan(worklists.box_typing(spark, SF))
    d = spark.createDataFrame([(1, "pot", "5T"), (1, "pot", "5T"), (1, "pot", "6T"), (1, "varietal", "7"), (1, "other", None), (2, "unlabeled", None)], "photo long, kind string, value string")
    got = {r.photo: (r.boxes, r.typed_ratio, r.pots, r.varietals, r.others, r.pot_ids, r.varietal_numbers) for r in report.box_typing(d, "photo").collect()}
    assert got == {1: (5, 1.0, 3, 1, 1, 2, 1), 2: (1, 0.0, 0, 0, 0, 0, 0)}
