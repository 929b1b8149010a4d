"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: u, v (long). Returns node, root for every linked node but the roots; root is the component's smallest node.

    Each round points nodes at their smallest neighbour; rounds grow with the logarithm of the longest path. Minima are
    combined before their shuffle and written, so that the join on a node with very many links is a plain equi-join,
    which is broadcast below Spark's size limit and split by adaptive execution beyond it. Only two numbers, to tell the
    end, come to the driver.
    """
    edges = stage(spark, links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while edges.take(1):  # each round but the last lowers the sum of the nodes pointed at, so there is a last one
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(spark, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large")
        large = stage(spark, both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = stage(spark, large.groupBy("u").agg(F.min("v").alias("m")), "small")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(spark, small.union(least).distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
