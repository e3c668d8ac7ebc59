"""Connected components by alternating large-star and small-star rounds on a DataFrame of edges.

Every round joins edges with the least neighbour of each node, which is aggregated before the join; a node with many
edges is one row on that side, so Spark can split the other. Rounds are checkpointed in the shared folder, and only a
count and a checksum reach the driver. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.session import cut


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that links reach, for every node that has a link to another node.

    Links with a null end and links of a node with itself are dropped.
    """
    greater, lesser = F.greatest(a, b), F.least(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(greater.alias("a"), lesser.alias("b")).where("a > b").distinct()
    edges = cut(edges)
    seen = _checksum(edges)
    while seen[0]:
        edges = cut(_round(edges))
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct()
