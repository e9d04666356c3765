"""A total order over all rows without one task that holds them: ranges of the key, then positions within each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.llm.common import parts, stored


def ranked(df: DataFrame, keys: list[Column], row: str = "_row", ranges: int | None = None) -> DataFrame:
    """df with each row's position (from 0) in the order of keys. Give few and narrow columns: they are written once and shuffled twice.

    The rows are dealt to ranges of the keys, and the number of each row's range is written with it, so that a lost task repeats nothing
    but itself. Ranges are then counted (one number each) and every row gets the rows before its range plus its place there.
    """
    n = ranges or parts(df.sparkSession)
    dealt = stored(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    before = counts.select("_range", F.coalesce(earlier, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(row, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")
