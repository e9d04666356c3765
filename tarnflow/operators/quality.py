"""Invariants as counts: a report is one row for each, 0 where it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _n(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys are there more than once."""
    return _n(df.groupBy(*keys).count().filter("count > 1"))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows lack one of the columns."""
    return _n(df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])))


def folded_collisions(df: DataFrame, key: str) -> DataFrame:
    """How many ids differ by case alone."""
    return _n(df.groupBy(F.lower(key)).agg(F.count_distinct(key).alias("c")).filter("c > 1"))


def unreconciled(whole: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """By how many rows the parts differ from the whole."""
    counts = reduce(DataFrame.unionByName, [whole.agg(F.count("*").alias("c")), *[p.agg((-F.count("*")).alias("c")) for p in parts]])
    return counts.agg(F.abs(F.sum("c")).alias("n"))


def unrecorded(present: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """What is there and not in the record."""
    return present.join(recorded.select(key).distinct(), key, "left_anti")


def report(findings: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("finding"), F.col("n").cast("long").alias("n")) for name, df in findings.items()])
