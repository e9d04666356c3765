"""Digests that only rows decide."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import digest

ROWS = [(1, "a", 1.5, [1, 2], {"x": 1, "y": 2}, b"\x00"), (2, None, None, None, None, None), (2, "", 0.0, [], {}, b""), (3, "ab", -1.0, [None], {"z": None}, b"\xff"), (3, "ab", -1.0, [None], {"z": None}, b"\xff")]
SCHEMA = "k int, s string, d double, a array<int>, m map<string,int>, b binary"


def test_order_files_and_partitions_do_not_matter(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = digest.digest(df)
    assert want[1] == 5
    spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(4).write.parquet(str(tmp_path / "t"))
    assert digest.digest(spark.read.parquet(str(tmp_path / "t"))) == want
    assert digest.digest(df.select(*reversed(df.columns))) == want


def test_a_changed_cell_a_row_more_or_another_type_do(spark):
    want = digest.digest(spark.createDataFrame(ROWS, SCHEMA))[0]
    others = [ROWS[:4], ROWS + ROWS[:1], [(1, "a", 1.5, [2, 1], {"x": 1, "y": 2}, b"\x00"), *ROWS[1:]], [ROWS[0], (2, "", None, None, None, None), *ROWS[2:]], [ROWS[0], ROWS[1], (2, "", 0.0, None, {}, b""), *ROWS[3:]]]
    found = {digest.digest(spark.createDataFrame(rows, SCHEMA))[0] for rows in others} | {digest.digest(spark.createDataFrame(ROWS, SCHEMA.replace("k int", "k long")))[0]}
    assert len(found) == len(others) + 1 and want not in found


def test_values_do_not_run_into_each_other(spark):
    one, other = (digest.digest(spark.createDataFrame([r], "a string, b string"))[0] for r in (("x;b:string:1=y", ""), ("x", "b:string:1=y")))
    assert one != other


def test_empty(spark):
    assert digest.digest(spark.createDataFrame([], SCHEMA))[1] == 0
    assert digest.differing(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA)).collect() == []


def test_differences_are_found(spark):
    one = spark.range(2000).select("id", F.lit("v").alias("v"))
    other = one.withColumn("v", F.when(F.col("id") == 77, "w").otherwise("v")).unionByName(one.filter("id = 5"))
    assert sorted(tuple(r) for r in digest.differing(one, other).collect()) == [(5, "v", "other", 1), (77, "v", "one", 1), (77, "w", "other", 1)]
