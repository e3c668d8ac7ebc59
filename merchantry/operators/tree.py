"""Category trees by adjacency lists.

A tree's closure (each node with each of its ancestors and itself) comes from rounds that join the frontier with the
edges. Recursive SQL would do the same but stops at a million rows unless told otherwise. Rounds end at `depth`, so cycles
end too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.session import cut


def closure(edges: DataFrame, depth: int = 16) -> DataFrame:
    """node, ancestor, distance (0 for itself) of a table node, parent; roots have a null parent."""
    up = edges.select(F.col("node").alias("_node"), F.col("parent").alias("_parent")).where("_parent is not null")
    frontier = edges.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    out = frontier
    for d in range(1, depth + 1):
        frontier = cut(frontier.join(up, F.col("ancestor") == F.col("_node")).select("node", F.col("_parent").alias("ancestor"), F.lit(d).alias("distance")))
        if frontier.isEmpty():
            break
        out = out.union(frontier)
    return out


def descendants(edges: DataFrame, root: object, depth: int = 16) -> DataFrame:
    """Nodes below root, and their distance; the root itself is not one."""
    return closure(edges, depth).where((F.col("ancestor") == F.lit(root)) & (F.col("distance") > 0)).select("node", "distance")


def paths(edges: DataFrame, names: DataFrame, sep: str = " > ") -> DataFrame:
    """node and the names from the root to it. names: node, name."""
    steps = closure(edges).join(names.withColumnRenamed("node", "ancestor"), "ancestor")
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("distance", "name"))))
    return steps.groupBy("node").agg(F.array_join(F.transform(ordered, lambda s: s["name"]), sep).alias("path"))


def rollup(edges: DataFrame, counts: DataFrame, columns: list[str]) -> DataFrame:
    """Each node's own counts plus those of all its descendants. Counts are per node before the join, and summed by
    ancestor with partial sums, so a root is one row from each task."""
    joined = closure(edges).join(counts, "node", "left")
    return joined.groupBy(F.col("ancestor").alias("node")).agg(*(F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in columns))


def flatten(tree: Column, levels: int = 3) -> list[Column]:
    """Rows (as arrays of id, parent, name) of each level of nested {name, children} JSON structs; ids as category_code."""
    first = F.transform(tree, lambda t, m: F.struct((10 + m).alias("id"), F.lit(0).alias("parent"), t["name"].alias("name")))
    second = F.flatten(F.transform(tree, lambda t, m: F.transform(t["children"], lambda u, k: F.struct((100 + 10 * k + m).alias("id"), (10 + m).alias("parent"), u["name"].alias("name")))))
    third = F.flatten(
        F.flatten(
            F.transform(
                tree,
                lambda t, m: F.transform(
                    t["children"],
                    lambda u, k: F.transform(u["children"], lambda v, i: F.struct((1000 + 100 * i + 10 * k + m).alias("id"), (100 + 10 * k + m).alias("parent"), v["name"].alias("name"))),
                ),
            )
        )
    )
    return [first, second, third][:levels]
