"""Tables written once and counted by the tasks that write them.

A count() beside a plan runs the plan again. Here a run's intermediate tables go to a folder of their own under the shared one, and what is to
be known of them is observed on the way. The observation stands on top of the plan, above its last exchange, so it is made by result tasks,
which Spark counts once each, however often lost executors make it run a shuffle's map side again. Readers of the table read files, and the
table may be used any number of times.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarnflow.session import shared_dir


class Meter:
    """The tables and counts of one run. counts: name -> number; times: how many tables were written, each by one run of its plan."""

    def __init__(self, spark: SparkSession):
        self.spark, self.times, self.counts = spark, 0, {}
        self.folder = f"{shared_dir(spark)}/metered-{uuid.uuid4().hex}"

    def held(self, df: DataFrame, table: str, **counts: Column) -> DataFrame:
        """df, written as `table` and read again. counts: name -> a boolean or whole number of each row, summed up; nulls count nothing. The
        table's rows are counted as its own name. A table without rows has counts of 0; a name is given once a run."""
        names = [table, *counts]
        if taken := sorted(set(names) & set(self.counts)):
            raise ValueError(f"counted before in this run: {taken}")
        seen = Observation()
        sums = [F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long")).alias(f"c{i}") for i, c in enumerate(counts.values())]
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *sums).write.parquet(f"{self.folder}/{table}")
        got, self.times = seen.get, self.times + 1
        self.counts |= {name: got.get(key, 0) for name, key in zip(names, ["rows", *[f"c{i}" for i in range(len(counts))]])}
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{table}")

    def release(self) -> None:
        """Delete the run's tables; what was read from them can't be read any more. A second call does nothing."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def __enter__(self) -> "Meter":
        return self

    def __exit__(self, *_) -> None:
        self.release()
