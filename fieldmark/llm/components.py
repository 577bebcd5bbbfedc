"""Connected components by alternating large and small stars, on links in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Re-links each vertex's neighbours (the larger ones, or those not larger) to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    linked = both.join(least, "a")
    kept = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return kept.where("a <> b").distinct()


def component_labels(links: DataFrame) -> DataFrame:
    """vertex, root for each vertex of ``links`` (a, b), the least vertex of its component as root.

    Every round is written to the shared folder; the loop ends when a round
    changes nothing, which takes about log(n) rounds.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        after = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if after == state or not after["n"]:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()
        state, before = after, edges
        edges = staged(_stars(_stars(edges, True), False), "links")
        discard(before)
