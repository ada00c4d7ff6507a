"""Connected components by alternating large and small stars (Kiveris et al., 2014), all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm._shared import materialize


def _are_stars(links: DataFrame) -> bool:
    """Whether each a has one link and is no link's b: then each b is the smallest node of its component."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return not nodes.agg(F.max(F.expr("ups > 1 or ups = 1 and least = 0"))).first()[0]


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b: long) -> (node, component): each node of a link, and the smallest node reachable.

    Nulls and self-links are ignored; repeated links count once. Each round is a written table, so
    a lost executor costs at most one round; the number of rounds grows with the logarithm of the
    longest chain. Rounds end where the links are stars. The per-node minima are written before they are joined: a node with very many
    links then leaves both sides of the join splittable by adaptive execution.
    """
    pairs = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = materialize(pairs.distinct(), "links")
    while not _are_stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = materialize(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "links")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
