"""Scans along an order that split a key over tasks: rows are dealt to ranges of (key, order), a range says what it adds, and each range
starts from what the ones before it said.

A window over a key sorts all the key's rows in one task. Here a key that holds a third of all rows lies in a third of the ranges: only rows
alike in keys and order, which no range parts, meet in one task, so callers end the order with something that tells rows apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.session import shared_dir


def _last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


#: How a state is made of values, and of the state before a range and the one in it.
KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "max": (F.max, lambda before, own: F.greatest(before, own)),
    "sum": (F.sum, lambda before, own: F.when(own.isNull(), before).otherwise(F.coalesce(before, F.lit(0)) + own)),
    "last": (_last, lambda before, own: F.coalesce(own, before)),
}


def ranged(df: DataFrame, keys: list[str], order: list[Column], parts: int | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with `_segment`: ranges of (keys, order), numbered along them. Written to the checkpoint folder, since ranges are cut from a sample
    and a second run of the plan might cut them elsewhere. hold: what writes it in place of a checkpoint, whose
    rows are not compressed."""
    spark = df.sparkSession
    shared_dir(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *keys, *order).withColumn("_segment", F.spark_partition_id())
    return hold(dealt) if hold else dealt.checkpoint()


def _met(rows: DataFrame, per_range: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with a column of their key's row in their range, null without one. Both lie by (range, key), so that no key is one task's."""
    told = per_range.select(F.col("_segment").alias("_s"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], column)
    on = F.col("_segment") == F.col("_s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(told, on, "left").drop("_s", *[f"_k{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, kind: str = "max", inclusive: bool = True, parts: int | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with `name`: the max, sum or last non-null of `value` over the key's rows up to the row (`inclusive`) or before it; null where there
    are none. Null keys are a key. Rows alike in keys and order follow each other in any order, as in a window over rows. hold: what writes the
    ranges and what they say, in place of a checkpoint of the ranges alone; `value` is then made of written rows."""
    fold, joined = KINDS[kind]
    rows = ranged(df, keys, order, parts, hold).withColumn("_value", value) if hold else ranged(df.withColumn("_value", value), keys, order, parts)
    inside = Window.partitionBy("_segment", *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row a key and range: at most as many as keys and ranges together.
    if hold and kind == "max":  # no order is needed, and so no shuffle
        sums = rows.groupBy("_segment", *keys).agg(fold(F.col("_value")).alias("_total"))
    else:
        sums = rows.withColumn("_total", fold(F.col("_value")).over(whole)).withColumn("_n", F.row_number().over(inside)).filter("_n = 1").select("_segment", *keys, "_total")
    earlier = fold(F.col("_total")).over(Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.withColumn("_before", earlier).filter("_before is not null")
    carried = hold(carried) if hold else carried
    own = rows.withColumn("_upto", fold(F.col("_value")).over(upto))
    return _met(own, carried, keys, "_before").select(*[F.col(c) for c in df.columns if c != name], joined(F.col("_before"), F.col("_upto")).alias(name))


def firsts(df: DataFrame, keys: list[str], order: list[Column], holder: list[str], parts: int | None = None) -> DataFrame:
    """df with `held`, whether the row is its key's first in the order, and the first row's columns as holder_<name>. Of rows alike in keys
    and order one is first."""
    rows = ranged(df, keys, order, parts).withColumn("_n", F.row_number().over(Window.partitionBy("_segment", *keys).orderBy(*order)))
    leads = rows.filter("_n = 1").select("_segment", *keys, F.struct(F.col("_segment").alias("s"), *[F.col(h).alias(f"h{i}") for i, h in enumerate(holder)]).alias("_own"))
    lead = leads.withColumn("_first", F.first("_own").over(Window.partitionBy(*keys).orderBy("_segment")))
    held = (F.col("_n") == 1) & (F.col("_segment") == F.col("_first.s"))
    return _met(rows, lead, keys, "_first").select(*df.columns, held.alias("held"), *[F.col(f"_first.h{i}").alias(f"holder_{h}") for i, h in enumerate(holder)])
