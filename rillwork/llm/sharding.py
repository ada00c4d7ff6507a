"""Sharding by rendezvous hashing of record keys over weighted shards.

A row goes to the shard with the highest score -weight / ln(u), u being a uniform hash of the key and
the shard's number. A new shard changes a row's place only if it wins, so rows move into it alone,
about its share of them. Keys decide alone: a key that a third of all rows share is one shard's by this law.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.llm._shared import materialize, read_table, with_default_columns

#: Rows of one input partition that are numbered together.
RUN = 16384


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard (0..len(weights) - 1) of a key. All null keys share one shard."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights are positive numbers, one per shard")

    def score(s: int, w: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        return F.struct((F.lit(-float(w)) / F.log(u)).alias("score"), F.lit(-s).alias("s"))

    scores = [score(s, w) for s, w in enumerate(weights)]
    return -(F.greatest(*scores) if len(scores) > 1 else scores[0])["s"]


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """docs(key, text) -> (key, size, text_crc32, law, shard, slot, grown_shard), equal weights.

    Slots number each shard's rows from 0 without gaps. Rows are numbered in runs of one input
    partition and offset by the runs before, so no task ever holds a shard, nor a frequent key's rows.
    A null text has size 1 and the checksum of nothing; rows with a null key share one shard; repeated rows each take
    a slot; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = materialize(
        with_default_columns(docs, **{key: "bigint", "text": "string"}).select(
            F.col(key).alias("k"), (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
            shard_of(F.col(key), [1.0] * shards).alias("shard"), shard_of(F.col(key), [1.0] * (shards + 1)).alias("grown_shard"), F.monotonically_increasing_id().alias("at"),
        ),
        "sharded",
    )
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("run", part * (1 << 20) + F.floor(place / RUN))
    runs = rows.groupBy("shard", "run").count()
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(runs.select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset")), "shard-offsets")
    inside = Window.partitionBy("shard", "run").orderBy("at")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["shard", "run"])
    return numbered.select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("place")).cast("bigint").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, weights: list[float], key: str = "doc_id", files: int = 1) -> None:
    """Write rows to path/shard=N; a shard's rows are dealt over ``files`` files."""
    if "shard" in docs.columns:
        raise ValueError("the rows already have a column named shard")
    placed = docs.withColumn("shard", shard_of(F.col(key), weights))
    placed.repartition("shard", (F.rand(7) * files).cast("int")).write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_table(spark, sf_dir, "documents"))
