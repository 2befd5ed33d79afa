"""Connected components of an undirected graph, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.llm.common import gathered

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b): the smallest node that each reaches.

    Large-star and small-star rounds (every node links its larger, then its smaller, neighbours to the smallest of
    them) until the edges are stars; a hub's neighbours are never gathered, only their minimum.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = gathered(both)
    before = None
    for _ in range(ROUNDS):
        ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: larger to smaller only
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = gathered(small.where("a <> b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("b").alias("component")))
