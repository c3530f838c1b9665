"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickpath.llm.store import release, stored


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)`` that is not its component's smallest node.

    Alternates two steps until nothing changes: each node hands its larger
    neighbours to the least node it sees, then its smaller ones. Minima are
    aggregated map-side and joined back on the node, so a hot node is never
    gathered in one task. Links of a node with itself and nulls are ignored.
    """
    edges = stored(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    last = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not seen[0] or tuple(seen) == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = tuple(seen)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(spark, large, "large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        done, edges = edges, stored(spark, small.where("u != v").distinct(), "edges")
        release(done, large)
