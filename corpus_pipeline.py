"""A corpus pipeline of five stages; each works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import bpe, mixing, quality, simhash, substrings
from rillwork.llm._shared import materialize, read_table

#: Documents with a lower calibrated probability of good quality go: the cut of op1's own ``predicted``.
LEAST_QUALITY = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier scores LEAST_QUALITY or more."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, *model, tuple(docs.columns)).where(F.col("__score") >= LEAST_QUALITY).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of pairs with a 5-word Jaccard similarity of 0.8 or more stays.

    It is the row with the least (doc_id, hash of the text), so that of rows that share a doc_id each component
    keeps its own. Rows without a doc_id belong to no component and stay; of rows equal in both one stays.
    """
    rows = docs.withColumn("__row", F.xxhash64(F.col("text").cast("string")))
    ids = rows.select("doc_id", F.col("__row").alias("row"), F.col("text").cast("string").alias("text"))
    least = simhash.least_of_similar(ids).select("doc_id", F.col("row").alias("__row"), F.lit(1).alias("least"), F.lit(0).alias("n"))
    each = least.unionByName(rows.where("doc_id is not null").select("doc_id", "__row", F.lit(0).alias("least"), F.lit(1).alias("n")))
    kept = materialize(each.groupBy("doc_id", "__row").agg(F.max("least").alias("least"), F.sum("n").alias("n")).where("least = 1"), "kept-rows")
    once = rows.join(kept.where("n = 1"), ["doc_id", "__row"], "left_semi")
    repeated = rows.join(kept.where("n > 1"), ["doc_id", "__row"], "left_semi").dropDuplicates(["doc_id", "__row"])
    return once.unionByName(repeated).unionByName(rows.where("doc_id is null")).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 35 words or more that occur elsewhere; texts without any are left as they are."""
    return substrings.clean(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their rates, so that expected tokens by language meet the targets; none is dropped."""
    labelled = mixing.labelled_part(docs, read_table(spark, sf_dir, "labels"), "lang")
    copied = mixing.with_copies(docs, labelled, mixing.TARGETS, min_rate=1.0)
    return copied.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and digests of them and of their decoding."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: No stage's decisions can be made in SQL; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each one's rows are written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
