"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(links: DataFrame) -> DataFrame:
    """(doc_id, root) of the ends of `links` (a, b): root is the smallest id that links reach.

    Alternates two steps until nothing changes, each a minimum for each node and a join: every larger
    neighbour of a node is tied to the node's least neighbour, then every smaller one and the node
    itself. The number of turns grows with the logarithm of a component's size. Each turn is written
    to the shared folder. Loops and repeated links don't matter; no links give no rows.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lows.select("u", F.col("m").alias("v")))
        old, edges = edges, written(small.where("u <> v").distinct(), "edges")
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select("u", "v")  # its table stays: what is returned reads it
    return roots.select(F.col("u").alias("doc_id"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("doc_id"), F.col("v").alias("root")).distinct())
