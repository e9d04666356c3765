"""Redirects followed to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.session import shared_dir


def admitted(edges: DataFrame, known: DataFrame, live: DataFrame, old: str, new: str, position: str) -> DataFrame:
    """(old, new): edges between known nodes whose source isn't live; the last edge of a source holds."""
    nodes, alive = known.select(F.col(known.columns[0]).alias("_k")).distinct(), live.select(F.col(live.columns[0]).alias("_k")).distinct()
    inside = edges.join(nodes.withColumnRenamed("_k", old), old, "left_semi").join(nodes.withColumnRenamed("_k", new), new, "left_semi").join(alive.withColumnRenamed("_k", old), old, "left_anti")
    return inside.groupBy(old).agg(F.max_by(new, position).alias(new))


def closure(edges: DataFrame, old: str, new: str, live: DataFrame | None = None) -> DataFrame:
    """(old, new, outcome) with new the end that old's redirects lead to.

    outcome: resolved, dead_end (the end isn't live) or cycle (there is no end; new is null). Pointers are doubled, so the rounds grow
    with the logarithm of the longest chain; each round is written to the checkpoint folder.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.col(old).alias("a"), F.col(new).alias("b")).checkpoint()
    hops, nodes = 1, now.count()
    while hops <= nodes:
        on = now.select(F.col("a").alias("b"), F.col("b").alias("c"))
        after = now.join(on, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved")).checkpoint()
        moved = not after.filter("moved").isEmpty()
        now, hops = after.select("a", "b"), hops * 2
        if not moved:
            break
    # What still points at a source after as many hops as there are nodes is on a cycle or leads to one.
    sources = edges.select(F.col(old).alias("b")).distinct().withColumn("loops", F.lit(True))
    ended = now.join(sources, "b", "left").withColumn("loops", F.coalesce("loops", F.lit(False)))
    if live is None:
        outcome = F.when(F.col("loops"), "cycle").otherwise("resolved")
    else:
        alive = live.select(F.col(live.columns[0]).alias("b")).distinct().withColumn("alive", F.lit(True))
        ended = ended.join(alive, "b", "left")
        outcome = F.when(F.col("loops"), "cycle").when(F.col("alive"), "resolved").otherwise("dead_end")
    return ended.select(F.col("a").alias(old), F.when(~F.col("loops"), F.col("b")).alias(new), outcome.alias("outcome"))
