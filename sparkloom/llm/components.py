"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has long columns a and b. Large-star and small-star steps alternate until
    the edges stay the same: each node ends with one edge, to its component. A step
    joins nodes with their smallest neighbours, so a node of very many neighbours is a
    key that adaptive execution may split; every round is written, which cuts the lineage.
    """
    checksum = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    edges = common.materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges", checksum=checksum)
    for _ in range(rounds):
        if common.is_empty(edges):
            break
        before = edges.measured
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).distinct()
        edges = common.materialize(small, "edges", checksum=checksum)
        if edges.measured == before:
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
