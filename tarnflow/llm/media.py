"""Media columns: texts' bytes as 8-bit grey images in zip archives, read back by a data source that plans byte ranges over the directories.

The stored form is a PNG image (grey, 8 bits, width 24, no row filter): lossless, and readable by any viewer. Each task writes one archive.
The source lists the folder, plans partitions as byte ranges of the archives, and opens none: the task of a range reads its archive's central
directory, takes the members that begin in the range, and streams their payloads in Arrow batches. A member that fails is opened again at
its own offset, without the others.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnflow.llm.common import crc, filesystem, moved, scratch, shared_dir, ship, stored

SIDE, PATCH = 24, 576
#: Bytes of an archive that one partition of the source reads.
RANGE_BYTES = 16 << 20
#: Bytes of stored members after which an archive is closed.
ARCHIVE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
TRIES = 4
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload and the length before padding: UTF-8, then bytes 255 up to a positive multiple of PATCH."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % PATCH if raw else PATCH), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", crc(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """A grey image, SIDE wide; its text chunk holds n_bytes."""
    rows = np.zeros((len(payload) // SIDE, SIDE + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    head = struct.pack(">IIBBBBB", SIDE, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """(payload, n_bytes). Every chunk's checksum is tested."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, pixels, n_bytes, width = 8, [], 0, 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != crc(kind + body):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            width, _, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            pixels.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(pixels)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("row filters aren't used here")
    return rows[:, 1:].tobytes(), n_bytes


def feature(payload: bytes) -> str:
    """Mean, spread and a 16-bin histogram (thousandths) of the samples, and the mean of each of up to 4 even bands of rows."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 4, minlength=16) * 1000 // len(samples)
    bands = [int(b.mean(dtype=np.float64)) for b in np.array_split(samples.reshape(-1, SIDE), 4)]
    return ":".join([f"{samples.mean(dtype=np.float64):.3f}", f"{samples.std(dtype=np.float64):.3f}", ",".join(map(str, bins)), ",".join(map(str, bands))])


def _archiver(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, rows, number = TaskContext.get(), [], 0
        attempt = context.taskAttemptId()

        def opened():
            store, path = filesystem(f"{folder}/media-{context.partitionId():06d}-{number:05d}.zip")
            store.create_dir(path.rpartition("/")[0], recursive=True)
            out = store.open_output_stream(f"{path}.{attempt}")
            return store, path, out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)

        def closed() -> None:
            archive.close()
            size = out.tell()
            out.close()
            moved(store, f"{path}.{attempt}", path)
            rows.append((f"{folder}/{path.rpartition('/')[2]}", size, count))

        store = path = out = archive = None
        count = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    (store, path, out, archive), count = opened(), 0
                archive.writestr(f"{count}/{'null' if doc_id is None else doc_id}.png", to_png(*padded(text)))
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    closed()
                    archive, number = None, number + 1
        if archive is not None:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 0 else pa.int64()) for k in range(3)], ["path", "bytes", "members"])

    return run


class ArchiveRange(InputPartition):
    """The members of an archive whose headers begin at bytes start to end (exclusive)."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def members_of(path: str, start: int, end: int) -> list[tuple[str, int, int, int]]:
    """(name, offset of its header, size, checksum) of each member that begins in the range, from the central directory alone."""
    store, name = filesystem(path)
    with store.open_input_file(name) as f, zipfile.ZipFile(f) as z:
        return sorted(((i.filename, i.header_offset, i.file_size, i.CRC) for i in z.infolist() if start <= i.header_offset < end), key=lambda m: m[1])


def payload_at(f, offset: int, size: int, check: int) -> bytes:
    """A stored member's bytes: past its local header, tested against the directory's checksum."""
    f.seek(offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise OSError(f"no member at {offset}")
    name, extra = struct.unpack_from("<HH", head, 26)
    f.seek(offset + 30 + name + extra)
    data = f.read(size)
    if len(data) != size or crc(data) != check:
        raise OSError(f"the member at {offset} is damaged")
    return data


def fetched(path: str, offset: int, size: int, check: int, f=None, tries: int = TRIES, pause: float = 0.2) -> bytes:
    """payload_at(), tried again with the archive opened anew; other members are not touched."""
    for k in range(tries):
        try:
            if f is not None and k == 0:
                return payload_at(f, offset, size, check)
            store, name = filesystem(path)
            with store.open_input_file(name) as again:
                return payload_at(again, offset, size, check)
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)
    raise AssertionError


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.range = options["path"].rstrip("/"), int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = filesystem(self.folder)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        sizes = sorted((f.base_name, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".zip"))
        return [ArchiveRange(f"{self.folder}/{name}", k, k + self.range) for name, size in sizes for k in range(0, size, self.range)] or [ArchiveRange("", 0, 0)]

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        keys, payloads, size = [], [], 0
        f, members = None, []
        if partition.path:
            store, name = filesystem(partition.path)
            f, members = store.open_input_file(name), members_of(partition.path, partition.start, partition.end)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(payloads, pa.binary())], ["doc_id", "media"])

        for member, offset, length, check in members:
            key = member.rpartition("/")[2].removesuffix(".png")
            keys.append(None if key == "null" else int(key))
            payloads.append(fetched(partition.path, offset, length, check, f))
            size += length
            if size >= BATCH_BYTES:
                yield batch()
                keys, payloads, size = [], [], 0
        if keys:
            yield batch()
        if f is not None:
            f.close()


class MediaSource(DataSource):
    """spark.read.format("tarnflow_media").load(folder of archives)."""

    @classmethod
    def name(cls) -> str:
        return "tarnflow_media"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            payload, n_bytes = from_png(media)
            rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), crc(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def write_media(docs: DataFrame, folder: str) -> DataFrame:
    """Store every document's payload as an image in archives under folder. Returns path, bytes and members of each archive.

    A null text counts as an empty one and gives one patch of bytes 255. Members are named by their place and doc_id, so repeated and null
    doc_ids all stay. An empty table writes no archive. Columns but doc_id and text aren't looked at.
    """
    ship(docs.sparkSession)
    return stored(docs.select("doc_id", "text").mapInArrow(_archiver(folder), "path string, bytes long, members long"), "archives")


def read_media(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and media (the stored bytes) of every member of the folder's archives."""
    ship(spark)
    spark.dataSource.register(MediaSource)
    return spark.read.format("tarnflow_media").load(folder)


def described(media: DataFrame) -> DataFrame:
    """What SCHEMA lists, from the bytes read back."""
    return media.mapInArrow(_described, SCHEMA)


def round_trip(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    shared_dir(spark)
    folder = scratch(spark, "media")
    write_media(docs, folder)
    return described(read_media(spark, folder))
