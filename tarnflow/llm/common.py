"""What the operators of this subpackage share: scratch folders, shipping, keys that may be hot."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts into which a key that may be hot is dealt.
SALTS = 64

_held: dict = {}


def held(key, make: Callable):
    """What a Python worker keeps from task to task, for one operator at a time: workers live on from stage to stage, and what other operators
    kept would add up."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Let go of what the worker keeps, where an operator keeps nothing itself, and give memory that is free in the worker (or the driver's
    Python) back to the system: neither Arrow's allocator nor the C library's would soon, and what stages have left there would add up."""
    import pyarrow as pa

    _held.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's alone
        trim(0)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's collector of cycles, for a stretch that makes very many small objects and no cycles: it would look through them, and
    through what the worker keeps, again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh local one where it is unset and the driver runs all tasks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(base)
    return base if "://" in base else "file://" + base


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there.

    Without a file that marks success, which nobody looks for: on a local folder the driver's JVM starts a process for each file it makes."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", codec).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of stored(), once nothing reads them any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers whatever their path is."""
    context, name = spark.sparkContext, "tarnflow_workers.zip"
    if name in getattr(context, "_python_includes", []):
        return
    top = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="tarnflow-ship-"), name)
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    context.addPyFile(target)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salt(by) -> F.Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def lookup(df: DataFrame, key: str, table: DataFrame, spread: str, how: str = "inner") -> DataFrame:
    """df joined with table (one row for each value of key) on key, where one value of key may hold most of df's rows.

    Rows are dealt by (key, salt of the column spread). A table row is repeated only for the (key, salt) pairs that exist in df, so the
    copies are never more than df's rows or SALTS times the keys. Both sides of every shuffle stay even.
    """
    left = df.withColumn("_salt", salt(F.col(spread)))
    pairs = left.filter(F.col(key).isNotNull()).select(key, "_salt").distinct()
    return left.join(pairs.join(table, key), [key, "_salt"], how).drop("_salt")


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes, attempt: str) -> None:
    """Write a file whole: under a name of this attempt first, then moved, so that a lost or repeated task leaves no part of one."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{path}.{attempt}") as out:
        out.write(data)
    moved(store, f"{path}.{attempt}", path)


def moved(store, source: str, target: str) -> None:
    """Give a whole file its name. Where an earlier attempt of the task has given the name to a file of the same bytes already, that stays:
    some stores refuse to move onto it."""
    from pyarrow import fs

    try:
        store.move(source, target)
    except OSError:
        at, here = store.get_file_info([target, source])
        if at.type != fs.FileType.File or at.size != here.size:
            raise
        store.delete_file(source)
