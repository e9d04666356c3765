"""Connected components of any size: edges contracted round by round, trees flattened by pointer jumping, no hot key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import drop_stored, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges: root is the smallest node that it can reach.

    In each round every node points to its smallest neighbour, if that is smaller; pointers are followed by doubling, and the edges are
    rewritten to the trees' roots. Rounds end when no edge is left between two roots; their number grows with the logarithm of the longest
    path. Each round's results are written to the shared folder, so both sides of every join are plain shuffles, and Spark splits those
    partitions that a root of most edges makes large.
    """
    ends = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b")
    left, mapping = stored(ends, "edges"), None
    while not left.isEmpty():
        near = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        tree = stored(near.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), "tree")
        while True:
            above = tree.select(F.col("node").alias("root"), F.col("root").alias("_above"))
            jumped = stored(tree.join(above, "root").select("node", "root", F.col("_above")), "tree")
            moved = not jumped.filter("root <> _above").isEmpty()
            drop_stored(tree)
            tree = jumped.select("node", F.col("_above").alias("root"))
            if not moved:
                break
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        if mapping is None:
            mapping = tree
        else:
            moved_up = mapping.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
            mapping = stored(moved_up, "mapping")
        for end in ("a", "b"):
            left = left.join(tree.select(F.col("node").alias(end), F.col("root").alias(f"_{end}")), end).withColumn(end, F.col(f"_{end}")).select("a", "b")
        left = stored(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    return mapping if mapping is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """components() of more edges (a, b) and those that gave roots: only the new edges are gone through, between the roots of their ends."""
    edges = stored(edges, "edges")
    if edges.isEmpty():
        return roots
    for end in ("a", "b"):
        up = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        edges = edges.join(up, end, "left").withColumn(end, F.coalesce("_root", end)).select("a", "b")
    above = stored(components(edges).select(F.col("node").alias("root"), F.col("root").alias("_above")), "above")
    old = roots.join(above, "root", "left").select("node", F.coalesce("_above", "root").alias("root"))
    # Roots that were no node of any edge before.
    new = above.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("_above").alias("root"))
    return stored(old.unionByName(new), "mapping")
