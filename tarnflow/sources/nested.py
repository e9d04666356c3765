"""Archives and archives in archives as a data source: byte ranges of the outer archive are partitions, members are streamed.

A partition reads the outer archive's central directory and then the members whose headers begin in its range, so a large archive is opened by
many tasks at once and none holds it. An inner archive is read through the stream of its own member; only its documents become rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DOCUMENTS = "source_artifact string, origin string, source_member string, source_document string, content string, problem string"
#: Bytes of an archive for each partition, and of content for each batch of rows.
RANGE_BYTES, BATCH_BYTES = 128 << 20, 16 << 20
_ORIGINS = {"library": "library", "sunset": "sunset", "loose": "loose"}
_DAMAGED = (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError)


def opened(path: str) -> IO[bytes]:
    """A file of any store that pyarrow knows, by the path that Spark lists it under."""
    from pyarrow import fs

    uri = re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/*", "file:///", path))
    store, name = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return store.open_input_file(name)


def barred(name: str, where: str) -> None:
    """An error for names with a part that begins with cui_."""
    if any(p.lower().startswith("cui_") for p in name.replace("\\", "/").split("/")):
        raise ValueError(f"controlled content is out of scope: {name} in {where}")


def _is_benchmark(stream: IO[bytes]) -> bool:
    """Whether the root element is a Benchmark and no document type is declared: read no further than the root."""
    parser = ElementTree.XMLPullParser(events=("start",))
    head = b""
    while data := stream.read(4096):
        head = (head + data)[:4096] if len(head) < 4096 else head
        try:
            parser.feed(data)
            for _, element in parser.read_events():
                return element.tag.rsplit("}", 1)[-1] == "Benchmark" and b"<!doctype" not in head.lower()
        except ElementTree.ParseError:
            return False
    return False


def _chosen(z: zipfile.ZipFile, start: int = 0, end: float = float("inf")) -> list[zipfile.ZipInfo]:
    """Benchmarks of one archive that begin in the range, by their place: manual ones by name, else any named so, else by root element."""
    infos = sorted(z.infolist(), key=lambda i: i.header_offset)
    named = [i for i in infos if i.filename.lower().endswith("xccdf.xml")]
    wanted = [i for i in named if "manual" in i.filename.lower()] or named
    inside = [i for i in wanted or infos if start <= i.header_offset < end]
    if wanted:
        return inside
    found = []
    for i in inside:
        if i.filename.lower().endswith(".xml"):
            try:
                with z.open(i) as stream:
                    if _is_benchmark(stream):
                        found.append(i)
            except _DAMAGED:
                continue
    return found


def documents_of(kind: str, name: str, f: IO[bytes], start: int = 0, end: float = float("inf")) -> Iterator[tuple]:
    """Rows of DOCUMENTS for the part of a file whose members begin in the range. What can't be read is a row with `problem`."""
    origin = _ORIGINS.get(kind, "product_zip")
    if kind == "loose":
        if start == 0:
            yield name, origin, None, name, f.read().decode("utf-8", "replace"), None
        return
    try:
        outer = zipfile.ZipFile(f)
    except _DAMAGED as e:
        if start == 0:
            yield name, origin, None, None, None, f"{name}: {e}"
        return
    for n in outer.namelist():
        barred(n, name)
    if kind not in ("library", "sunset"):
        yield from _documents(outer, _chosen(outer, start, end), name, origin, None)
    for info in sorted(outer.infolist(), key=lambda i: i.header_offset):
        if info.filename.lower().endswith(".zip") and start <= info.header_offset < end:
            try:
                # The member's stream can seek, so the inner archive is read through it and never held.
                with outer.open(info) as stream, zipfile.ZipFile(stream) as inner:
                    for n in inner.namelist():
                        barred(n, f"{info.filename} in {name}")
                    yield from _documents(inner, _chosen(inner), name, origin, info.filename)
            except _DAMAGED as e:
                yield name, origin, info.filename, None, None, f"{info.filename}: {e}"


def _documents(z: zipfile.ZipFile, infos: list[zipfile.ZipInfo], name: str, origin: str, member: str | None) -> Iterator[tuple]:
    for i in infos:
        try:
            yield name, origin, member or i.filename, i.filename, z.read(i).decode("utf-8", "replace"), None
        except _DAMAGED as e:
            yield name, origin, member, i.filename, None, f"{i.filename}: {e}"


class Range(InputPartition):
    def __init__(self, kind: str, name: str, path: str, start: int, end: int):
        self.kind, self.name, self.path, self.start, self.end = kind, name, path, start, end


class NestedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.range = json.loads(options["files"]), int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Ranges of every file, by its length alone; the last one of a file is open."""
        out = []
        for kind, name, path, length in self.files:
            starts = [0] if kind == "loose" else list(range(0, max(length, 1), self.range))
            out += [Range(kind, name, path, s, s + self.range if s != starts[-1] else 1 << 62) for s in starts]
        return out or [Range("loose", "", "", 1, 1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names, rows, held = [c.split()[0] for c in DOCUMENTS.split(", ")], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)

        with opened(partition.path) as f:
            for row in documents_of(partition.kind, partition.name, f, partition.start, partition.end):
                rows.append(row)
                held += len(row[4] or "")
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class NestedSource(DataSource):
    """spark.read.format("tarnflow_nested").option("files", JSON of [kind, name, path, length] each)."""

    @classmethod
    def name(cls) -> str:
        return "tarnflow_nested"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> DataSourceReader:
        return NestedReader(self.options)


def read_documents(spark: SparkSession, inventory: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The benchmarks in the files of an inventory (kind, name, path, length). The driver holds a line for each file, as its listing does."""
    files = [[r.kind, r["name"], r.path, r.length] for r in inventory.filter("kind is not null").select("kind", "name", "path", "length").orderBy("path").collect()]
    spark.dataSource.register(NestedSource)
    return spark.read.format("tarnflow_nested").option("files", json.dumps(files)).option("rangebytes", str(range_bytes)).load()


def hashed(files: DataFrame) -> DataFrame:
    """files (path, other columns) with sha256, streamed file by file; no file is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                with opened(path) as f:
                    out.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield batch.append_column("sha256", pa.array(out, pa.string()))

    return files.mapInArrow(run, ", ".join([f"`{n}` {t}" for n, t in files.dtypes] + ["sha256 string"]))
