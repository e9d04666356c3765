"""A published build packed for others, and a packed one verified and installed.

A release is a folder of compressed JSON lines by table, a checksum for every file, and what the release says of itself. Each file is verified
by a task that reads it as a stream: its first bytes, its digest, and what it unpacks to, which never goes beyond a cap.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import digest
from tarnflow.schema import SCHEMA_VERSION, TABLES
from tarnflow.sources import archives, nested, publish

#: What a file may unpack to at most, and how much of it is held at once.
CAP_BYTES, CHUNK = 16 << 30, 1 << 20
#: Fixed value: the first bytes of a gzip stream.
MAGIC = b"\x1f\x8b\x08"
CHECKSUMS, ABOUT, RECORD = "SHA256SUMS", "RELEASE", "INSTALLED"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(name below the folder, path) of the packed files; what they hold isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(folder)
    return found.select(F.concat_ws("/", F.element_at(F.split("path", "/"), -2), F.element_at(F.split("path", "/"), -1)).alias("name"), "path")


def pack(spark: SparkSession, root: str, folder: str, tag: str, date: str) -> dict:
    """Pack what is published under root into a new folder; returns what the release says of itself."""
    about = publish.release_doc(spark, root, tag, date)
    build = publish.pointer(spark, root)["build"]
    for t, (_, schema) in TABLES.items():
        spark.read.schema(schema).parquet(f"{build}/{t}").write.option("compression", "gzip").json(f"{folder}/{t}")
    sums = nested.hashed(_files(spark, folder)).select(F.concat("sha256", F.lit("  "), "name").alias("value"))
    sums.write.text(f"{folder}/{CHECKSUMS}")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{folder}/{ABOUT}")
    return about


def _unpacked(path: str, cap: int) -> tuple[int, str, str | None]:
    """(bytes unpacked, digest of the file, problem), reading and unpacking a chunk at a time."""
    sha, size, stream, problem = hashlib.sha256(), 0, zlib.decompressobj(wbits=31), None
    with nested.opened(path) as f:
        chunk = f.read(CHUNK)
        if not chunk.startswith(MAGIC):
            problem = "no packed table"
        while chunk:
            sha.update(chunk)
            rest = b"" if problem else chunk
            while rest and not problem:
                if stream.eof:
                    problem = "data after the end"
                    break
                try:
                    size += len(stream.decompress(rest, CHUNK))
                except zlib.error:
                    problem = "damaged"
                    break
                rest = stream.unconsumed_tail or stream.unused_data
                problem = "unpacks beyond the cap" if size > cap else None
            chunk = f.read(CHUNK)
    while not problem and not stream.eof:
        more = stream.decompress(b"", CHUNK)
        size += len(more)
        problem = "unpacks beyond the cap" if size > cap else None if more else "ends early"
    return size, sha.hexdigest(), problem


def verified(spark: SparkSession, folder: str, cap: int = CAP_BYTES) -> DataFrame:
    """(name, unpacked, problem) of every file that is there or has a checksum. Nothing but the cap's worth of a file is ever unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_unpacked(p, cap) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), *[pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]], ["name", "unpacked", "found", "problem"])

    there = _files(spark, folder).mapInArrow(run, "name string, unpacked long, found string, problem string")
    both = there.join(archives.checksums(spark, f"{folder}/{CHECKSUMS}"), "name", "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "no checksum").when(F.col("found") != F.col("sha256"), "another checksum").otherwise(F.col("problem"))
    return both.select("name", "unpacked", problem.alias("problem"))


def install(spark: SparkSession, folder: str, root: str, cap: int = CAP_BYTES) -> dict:
    """Verify a packed release, publish it under root and note it; ValueError, and nothing replaced, where anything is amiss.

    The schema must be this library's, every file whole, all of them together within the cap, keys unique, and the tables' digests those that
    the release states. Returns what was installed and what before."""
    about = json.loads(spark.read.text(f"{folder}/{ABOUT}").first().value)
    if about.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"the release has schema {about.get('schema_version')}, and {SCHEMA_VERSION} is read here")
    files = verified(spark, folder, cap)
    wrong = files.filter("problem is not null").orderBy("name").limit(5).collect()
    if wrong:
        raise ValueError("the release is refused: " + "; ".join(f"{r.name}: {r.problem}" for r in wrong))
    if (files.agg(F.sum("unpacked")).first()[0] or 0) > cap:
        raise ValueError("the release is refused: it unpacks beyond the cap")
    tables = {t: spark.read.schema(schema).json(f"{folder}/{t}") for t, (_, schema) in TABLES.items()}
    other = [t for t in TABLES if digest.digest(tables[t])[0] != about["digests"].get(t)]
    if other:
        raise ValueError(f"the release is refused: other rows than it states in {', '.join(other)}")
    publish.keyed(tables)
    before = installed(spark, root)
    publish.publish(spark, tables, root)
    spark.createDataFrame([(json.dumps({"release": about["tag"], "sha256": about["sha256"]}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root.rstrip('/')}/{RECORD}")
    return {"installed": about["tag"], "replaced": before}


def installed(spark: SparkSession, root: str) -> dict:
    """sha256 of what is published (null: nothing usable, and why), and what the last installation noted. A build made since has another hash,
    so that its record doesn't count for it (currency.decisions)."""
    out: dict = {"sha256": None, "problem": None, "recorded_sha256": None, "recorded_release": None}
    state = publish.readiness(spark, root)
    if state == "ready":
        out["sha256"] = publish._one_hash(publish.pointer(spark, root)["digests"])
    elif state != "no_knowledge_base":
        out["problem"] = state
    fs, at = publish._fs(spark, f"{root.rstrip('/')}/{RECORD}")
    if fs.exists(at):
        noted = json.loads(spark.read.text(f"{root.rstrip('/')}/{RECORD}").first().value)
        out |= {"recorded_sha256": noted["sha256"], "recorded_release": noted["release"]}
    return out
