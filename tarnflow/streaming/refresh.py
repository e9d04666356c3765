"""Source folders as streams: what arrives is recorded once, and a build runs for each batch that brings something new."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnflow.sources import manifest

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (name, sha256, size) of files as they arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(_BINARY).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def refreshed(spark: SparkSession, folder: str, root: str, checkpoint: str, rebuild: Callable[[DataFrame], None]) -> StreamingQuery:
    """Record what arrives in a manifest and call rebuild with the rows (name, sha256, size) whose content wasn't recorded before.

    Content that is known is state of the stream, by (name, sha256), so a batch costs what it brings, however long the manifest is; only the
    first batch of a new checkpoint is held against a manifest that other streams wrote. A batch that is run again after a failure finds the
    state of the one before it, gives the same rows, and replaces its own log. The state store is the session's: RocksDB where it is large.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def batch(rows: DataFrame, number: int) -> None:
        new = rows
        if number == 0:
            known, _ = manifest.read(spark, root)
            others = manifest.latest(known.filter(~F.startswith("log", F.lit(f"{run}-"))).drop("log"))
            new = rows.join(others.select("name", "sha256"), ["name", "sha256"], "left_anti")
        log = f"{run}-{number:012d}"
        manifest.append(new.select("name", "sha256", F.col("size").alias("size_bytes"), F.col("size").alias("on_disk_bytes")), root, log, int(time.time() * 1000))
        fresh, _ = manifest.parsed(spark.read.text(f"{root.rstrip('/')}/log={log}"))
        fresh = fresh.select("name", "sha256", F.col("size_bytes").alias("size"))
        if not fresh.isEmpty():
            rebuild(fresh)

    once = arrivals(spark, folder).dropDuplicates(["name", "sha256"])
    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events of each type in each window; rows later than `late` are dropped. Works on streams and on tables."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
