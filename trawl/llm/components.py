"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.shared import materialise


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one link up at most and none leads up from a root: then roots are found."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).select((F.col("up") + F.col("root") > 1) & (F.col("up") > 0))
    return not odd.toDF("odd").agg(F.max("odd")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node reachable.

    ``edges`` has orderable columns a and b; null ends, loops and repeats are ignored. Each
    round's links are written to the shared folder. The smallest neighbours are a written
    table too, so both sides of the joins are plain shuffles which a hub's partition can be
    split in.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", share=16)
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low", share=16)
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large", share=16)
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low", share=16)
        pairs = large.join(low, "a")
        small = pairs.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialise(small.distinct(), "links", share=16)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
