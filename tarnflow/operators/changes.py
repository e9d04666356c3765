"""Snapshots compared, merged and pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, before, after) of what is new, changed or withdrawn."""
    a, b = before.select(key, F.col(value).alias("before"), F.lit(True).alias("_b")), after.select(key, F.col(value).alias("after"), F.lit(True).alias("_a"))
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "withdrawn").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return a.join(b, key, "full").withColumn("change", change).filter(F.col("change").isNotNull()).select(key, "change", "before", "after")


def merged(base: DataFrame, new: DataFrame, key: str, value: str, cleared: str) -> DataFrame:
    """All of base, what it lacks from new; where both have a key with another value, new's value and `cleared` set to null."""
    n = new.select(key, F.col(value).alias("_value"), *[F.col(c).alias(f"_{c}") for c in new.columns if c not in (key, value)], F.lit(True).alias("_n"))
    both = base.withColumn("_b", F.lit(True)).join(n, key, "full")
    reissued = F.col("_b") & F.col("_n") & ~F.col(value).eqNullSafe(F.col("_value"))
    out = {value: F.when(F.col("_n"), F.col("_value")).otherwise(F.col(value))}
    out[cleared] = F.when(reissued, F.lit(None)).when(F.col("_b"), F.col(cleared)).otherwise(F.col(f"_{cleared}"))
    return both.select(key, *[out[c].alias(c) if c in out else F.coalesce(c, f"_{c}").alias(c) if f"_{c}" in both.columns else F.col(c) for c in base.columns if c != key])


def pruned(df: DataFrame, product: list[str], release: list[str], keep: Column) -> DataFrame:
    """df with `fate`: retained where keep holds or no product can be told, superseded where a later release of the product is there."""
    known = F.lit(True)
    for p in product:
        known = known & F.col(p).isNotNull()
    newest = F.max(F.struct(*release)).over(Window.partitionBy(*product))
    fate = F.when(keep | ~known, "retained").when(F.struct(*release) < newest, "superseded").otherwise("retained")
    return df.withColumn("fate", fate)


def drop_share(before: DataFrame, after: DataFrame, key: str, most: float) -> DataFrame:
    """One row: recorded, dropped, refused (more than the share `most` would go)."""
    gone = before.join(after.select(key), key, "left_anti")
    return before.agg(F.count("*").alias("recorded")).crossJoin(gone.agg(F.count("*").alias("dropped"))).withColumn("refused", F.col("dropped") > F.col("recorded") * most)  # one row each


def unequal(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that are in one build only, with the side: empty for equal builds, repeated rows counted."""
    return one.exceptAll(other).withColumn("side", F.lit("one")).unionByName(other.exceptAll(one).withColumn("side", F.lit("other")))


def compared(stored: Column, published: Column) -> Column:
    """newer, same or older, of what is published; incomparable where either can't be told."""
    return F.when(stored.isNull() | published.isNull(), "incomparable").when(published > stored, "newer").when(published < stored, "older").otherwise("same")


def stale(published: DataFrame, stored: DataFrame, keys: list[str], major: str, release: str) -> DataFrame:
    """published with `finding`: stale (a stored release of the same key and major is older), other_major, unmatched, or current."""
    at_major = stored.groupBy(*keys, major).agg(F.max(release).alias("_stored"))
    at_key = stored.select(*keys).distinct().withColumn("_any", F.lit(True))
    joined = published.join(at_major, [*keys, major], "left").join(at_key, keys, "left")
    finding = F.when(F.col("_stored") < F.col(release), "stale").when(F.col("_stored").isNotNull(), "current").when(F.col("_any"), "other_major").otherwise("unmatched")
    return joined.withColumn("finding", finding).drop("_stored", "_any")


def actions(sources: DataFrame) -> DataFrame:
    """sources (source, recorded, published, problem) with `action`: none, refresh (recorded and changed), ingest (never recorded), or skip where
    its listing couldn't be read, which holds no other source up."""
    action = F.when(F.col("problem").isNotNull(), "skip").when(F.col("recorded").isNull(), "ingest").when(F.col("recorded").eqNullSafe(F.col("published")), "none").otherwise("refresh")
    return sources.withColumn("action", action)


def unchanged(present: DataFrame, recorded: DataFrame, key: str, length: str) -> DataFrame:
    """What is there with the length that was recorded when it was fetched; records without a length never match."""
    known = recorded.filter(F.col(length).isNotNull()).select(key, F.col(length).alias("_length"))
    return present.join(known, key).filter(F.col(length) == F.col("_length")).drop("_length")
