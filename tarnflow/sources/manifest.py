"""What was fetched, as logs of rows that are only ever added: the last row of a name holds, a tombstone ends it, a row that can't be read costs
itself alone.

A log is a folder of JSON lines under the manifest's root, written whole in one rename under a name of the writer's, so that a writer who comes
again replaces its own. Old logs are folded into one; tombstones are folded too, so any mix of a fold and the logs that it covers says the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import ids

FIELDS = "name string, date string, size_bytes long, on_disk_bytes long, sha256 string, removed boolean, at long"
_COLUMNS = ["name", "date", "size_bytes", "on_disk_bytes", "sha256", "removed", "at"]
_FOLD = "fold-"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of lines (value): what is no record, whose name isn't a plain file name (it would reach out of its folder), or whose
    digest or order can't be read is a problem (value, problem)."""
    read = lines.withColumn("r", F.from_json("value", f"{FIELDS}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    problem = (
        F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "no record")
        .when(F.col("r.name").isNull() | ~F.coalesce(ids.is_bare_name(F.col("r.name")), F.lit(False)), "no plain file name")
        .when(F.col("r.at").isNull(), "no order")
        .when(F.col("r.sha256").isNotNull() & ~F.col("r.sha256").rlike("^[0-9a-f]{64}$"), "no digest")
    )
    told = read.withColumn("problem", problem)
    rows = told.filter("problem is null").select("r.*", *[c for c in lines.columns if c != "value"]).drop("_bad")
    return rows.withColumn("removed", F.coalesce("removed", F.lit(False))), told.filter("problem is not null").select("value", "problem")


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their log, problems) of all logs; without a manifest both are empty."""
    fs, at = _fs(spark, root)
    if not fs.exists(at) or not any(_logs(spark, root)):
        return parsed(spark.createDataFrame([], "value string, log string"))
    return parsed(spark.read.schema("value string, log string").text(root))


def _logs(spark: SparkSession, root: str) -> list[str]:
    fs, at = _fs(spark, root)
    return sorted(s.getPath().getName().removeprefix("log=") for s in fs.listStatus(at) if s.getPath().getName().startswith("log=")) if fs.exists(at) else []


def latest(rows: DataFrame, tombstones: bool = False) -> DataFrame:
    """The last row of each name by `at`, removal first among equals, then by the row itself; names that were removed last are left out."""
    order = F.struct("at", "removed", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in ("date", "size_bytes", "on_disk_bytes", "sha256")])
    last = rows.groupBy("name").agg(F.max_by(F.struct(*_COLUMNS[1:]), order).alias("r")).select("name", "r.*")
    return last if tombstones else last.filter(~F.col("removed"))


def _written(rows: DataFrame, root: str, log: str) -> None:
    """Write aside, then give the log its name."""
    spark = rows.sparkSession
    aside = f"{root.rstrip('/')}/.{uuid.uuid4().hex}"
    fs, made = _fs(spark, aside)
    fs.mkdirs(_fs(spark, root)[1])
    try:
        rows.select(F.to_json(F.struct(*_COLUMNS)).alias("value")).write.text(aside)
        at = _fs(spark, f"{root.rstrip('/')}/log={log}")[1]
        fs.delete(at, True)
        if not fs.rename(made, at):
            raise OSError(f"log {log} couldn't be named")
    except Exception:
        fs.delete(made, True)
        raise


def append(rows: DataFrame, root: str, log: str, at: int) -> None:
    """Add rows (name and any of date, size_bytes, on_disk_bytes, sha256, removed) as one log. A log of that name is replaced."""
    if not log or "/" in log or log.startswith(_FOLD):
        raise ValueError(f"no name for a log: {log!r}")
    types = dict(f.split() for f in FIELDS.split(", "))
    whole = [F.col(c) if c in rows.columns else F.lit(None).cast(types[c]).alias(c) for c in _COLUMNS if c != "at"]
    _written(rows.select(*whole, F.lit(at).cast("long").alias("at")), root, log)


def vouched(entries: DataFrame, present: DataFrame, sure: Column | None = None) -> DataFrame:
    """entries (name, date, size_bytes) with length and digest of what is there (name, length, sha256), where `sure` says that this run took
    it; others get neither, so that a file which nobody fetched never counts as fetched."""
    there = present.select("name", F.col("length").alias("_length"), F.col("sha256").alias("_sha"))
    taken = F.coalesce(sure if sure is not None else F.lit(True), F.lit(False))
    return entries.join(there, "name", "left").select(*entries.columns, F.when(taken, F.col("_length")).alias("on_disk_bytes"), F.when(taken, F.col("_sha")).alias("sha256"))


def folded(spark: SparkSession, root: str) -> int:
    """Fold all logs that are there into one and delete them; returns how many there were. Rows that can't be read go with them. Logs that come
    meanwhile stay as they are."""
    logs = _logs(spark, root)
    if len(logs) < 2:
        return len(logs)
    rows, _ = parsed(spark.read.schema("value string, log string").option("basePath", root).text([f"{root.rstrip('/')}/log={x}" for x in logs]))
    _written(latest(rows, tombstones=True), root, f"{_FOLD}{uuid.uuid4().hex}")
    fs, _ = _fs(spark, root)
    for x in logs:
        fs.delete(_fs(spark, f"{root.rstrip('/')}/log={x}")[1], True)
    return len(logs)
