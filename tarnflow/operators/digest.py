"""A table's digest that does not depend on files, order or partitioning: counts and sums of keyed hashes of its rows.

Each row becomes a text of its columns by name, with type and length, so that no two different rows share one. Two 60-bit numbers of the text's
SHA-256 are summed without overflow; equal rows count as often as they occur, and partial sums meet in any order. Sums are kept by part, a third
number of the hash, so that where two tables differ only the parts that do need be read again. No row is shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: Parts into which rows fall by their own hash.
PARTS = 64


def row_text(df: DataFrame) -> Column:
    """A row as text, the columns in order of their names; a null has no length. Maps are sorted by key; binary values are written in hex."""

    def told(c: str, kind) -> Column:
        if isinstance(kind, MapType):
            return F.to_json(F.array_sort(F.map_entries(c)))
        if isinstance(kind, (ArrayType, StructType)):
            return F.to_json(F.struct(F.col(c)), {"ignoreNullFields": "false"})
        return F.hex(c) if kind.simpleString() == "binary" else F.col(c).cast("string")

    def part(c: str, kind) -> Column:
        text = told(f"`{c}`", kind)
        return F.concat(F.lit(f"{c}:{kind.simpleString()}:"), F.when(F.col(f"`{c}`").isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit("="), text)), F.lit(";"))

    return F.concat(*[part(f.name, f.dataType) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def _number(hashed: str, start: int) -> Column:
    return F.conv(F.substring(hashed, start, 15), 16, 10).cast("decimal(38,0)")


def hashed(df: DataFrame) -> DataFrame:
    """df with _part, _a and _b of each row's hash."""
    rows = df.withColumn("_h", F.sha2(row_text(df), 256))
    part = F.pmod(F.conv(F.substring("_h", 31, 8), 16, 10).cast("long"), F.lit(PARTS)).cast("int")
    return rows.withColumn("_part", part).withColumn("_a", _number("_h", 1)).withColumn("_b", _number("_h", 16)).drop("_h")


def parts(df: DataFrame) -> DataFrame:
    """(part, rows, a, b): the sums of each part that has rows; PARTS rows at most."""
    return hashed(df).groupBy(F.col("_part").alias("part")).agg(F.count("*").alias("rows"), F.sum("_a").alias("a"), F.sum("_b").alias("b"))


def digest(df: DataFrame) -> tuple[str, int]:
    """(digest of schema and rows, number of rows) by one aggregation."""
    found = sorted(tuple(r) for r in parts(df).collect())  # PARTS rows at most
    schema = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return hashlib.sha256(repr((schema, [(p, n, int(a), int(b)) for p, n, a, b in found])).encode()).hexdigest(), sum(r[1] for r in found)


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with `side` and `times`: only parts whose sums differ are looked at row by row."""
    if sorted(one.dtypes) != sorted(other.dtypes):
        raise ValueError("the tables differ in columns or types")
    a, b = ({tuple(r) for r in parts(df).collect()} for df in (one, other))  # PARTS rows at most
    wanted = sorted({r[0] for r in a ^ b})
    columns = one.columns
    left, right = (hashed(df).filter(F.col("_part").isin(wanted) if wanted else F.lit(False)).select(*columns, "_a", "_b", F.lit(n).alias("_n")) for df, n in ((one, 1), (other, -1)))
    counted = left.unionByName(right).groupBy("_a", "_b").agg(F.sum("_n").alias("_n"), F.first(F.struct(*columns)).alias("row"))
    return counted.filter("_n <> 0").select("row.*", F.when(F.col("_n") > 0, "one").otherwise("other").alias("side"), F.abs("_n").alias("times"))
