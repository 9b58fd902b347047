"""A training corpus in five stages: quality, near duplicates, benchmark passages, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import decontam, jaccard, mixing, quality, sharding
from fieldlens.llm.common import free_name, read_table, scratch


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs."""
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    net = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, net)
    return _like(scored.filter(F.col("predicted") == 1), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the least id) of each component of five-word Jaccard similarity 0.8 or more.

    Rows that repeat an id are told apart by a row number that is stored with them, as one taken anew in each plan
    depends on how the files are split.
    """
    number, uid = free_name(docs, "_row"), free_name(docs, "_uid")
    numbered = scratch(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    named = numbered.withColumn(uid, F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(number).alias("i")))
    linked = jaccard.jaccard_join(named, n=5, num=80, den=100, doc_id=uid, keep=[uid], count_links=False)
    kept = linked.filter(F.col(uid) == F.col("component_id")).select(F.col(f"{uid}.i").alias("_i"))
    return _like(numbered.join(kept, F.col(number) == F.col("_i"), "left_semi"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a ten-word window (or a whole shorter item) of the benchmark."""
    judged = decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return _like(judged.filter(~F.col("contaminated")), docs)


#: Target shares: toxic text is to be a fiftieth of what is clean or toxic. Domain `low`, which text in languages without
#: labels is much like, keeps its share.
MIXTURE = {"clean": 0.98, "toxic": 0.02}


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by their rates, so that the expected domain token totals meet the targets."""
    mixed = mixing.mix(docs, read_table(spark, sf_dir, "labels"), MIXTURE)
    copies = mixed.filter(F.col("copies") > 0).withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return _like(copies, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to 40 shards of near equal bytes."""
    return sharding.shard_by_bytes(docs, shards=40)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_domains),
    ("sharding", shard),
]

#: SQL cannot express the trained stages; tests/llm holds near duplicates and decontamination against brute force, and each trained stage against its model's scores.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch(docs, f"stage{i}")
    return docs
