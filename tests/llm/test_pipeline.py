"""Each stage of the pipeline against a plain version over its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fieldlens.llm import mixing, quality

from .test_operators import brute_components, brute_decontam

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, f in cp.STAGES:
        out.append(cp.scratch(f(spark, out[-1], SMALL), "test-stage"))
    return out


def rows(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert stages[-1].columns[: len(stages[0].columns)] == stages[0].columns


def test_quality_keeps_what_it_predicts(spark, stages):
    net = quality.train(stages[0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert rows(stages[1]) == rows(quality.score_quality(stages[0], net).filter("score >= 0.3"))
    good = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1 AND toxic = 0").join(stages[0], "doc_id")
    assert good.join(stages[1], "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_one_of_each_near_duplicate_group(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    want = {(d) for d, _, c in brute_components(before, 5, 80, 100) if d == c}
    assert {d for d, _ in rows(stages[2])} == want and stages[2].count() == len(want)


def test_decontaminated(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = Counter(x for x in rows(stages[2]) if not brute_decontam(x[1], items)[-1])
    assert rows(stages[3]) == want


def test_mixture_follows_rates(spark, stages):
    mixed = mixing.mix(stages[3], spark.read.parquet(f"{SMALL}/labels.parquet"), cp.MIXTURE).select("doc_id", "copies").collect()
    got = Counter(r["doc_id"] for r in stages[4].collect())
    assert got == Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})
    judged = mixing.mix(stages[3], spark.read.parquet(f"{SMALL}/labels.parquet"), cp.MIXTURE)
    n = F.col("n_tokens")
    sums = judged.agg(*(F.sum(F.col("rate") * n * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS), F.sum(n).alias("all")).first()
    before = judged.agg(F.sum(n * F.col("p_low")).alias("low")).first()["low"]
    assert abs(sums["low"] - before) < 1e-3 * sums["all"] and abs(sums["toxic"] / (sums["clean"] + sums["toxic"]) - cp.MIXTURE["toxic"]) < 1e-3
    clean = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1 AND toxic = 0").join(stages[3], "doc_id").select("doc_id").collect()
    assert sum(got[r["doc_id"]] > 0 for r in clean) >= 0.97 * len(clean)


def test_shards_hold_all(stages):
    assert rows(stages[5].select("doc_id", "text")) == rows(stages[4])
    per = stages[5].groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("s"), F.max("size").alias("m")).collect()
    mean = sum(r["b"] for r in per) / 40
    most = max(r["m"] for r in per)
    assert all(r["s"] == r["n"] - 1 and abs(r["b"] - mean) <= most + 0.001 * mean for r in per)


def test_repeated_ids_lose_no_document(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "q r s t u v w"), (None, "x y"), (None, "x y"), (2, None)], "doc_id long, text string")
    kept = cp.drop_near_duplicates(spark, docs.repartition(2).transform(lambda d: cp.scratch(d, "test-docs")), SMALL)
    assert sorted((r["text"] or "") for r in kept.collect()) == ["", "a b c d e f g", "q r s t u v w", "x y"]


def test_other_file_splits_keep_the_same_rows(spark, monkeypatch):
    docs = cp.scratch(spark.createDataFrame([(i, f"word{i} a{i} b{i} c{i} d{i} e{i}") for i in range(50)], "doc_id long, text string").coalesce(1), "test-docs")
    join, before = cp.jaccard.jaccard_join, {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def split_anew(*a, **b):
        out = join(*a, **b)
        for k in before:
            spark.conf.set(k, "200")
        return out

    monkeypatch.setattr(cp.jaccard, "jaccard_join", split_anew)
    try:
        assert sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, SMALL).collect()) == list(range(50))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
