"""Token-id output: documents' ids in Huffman files in the order of their keys, and the way back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.llm import huffman
from tarnflow.llm.common import crc, filesystem, parts, put, scratch, shared_dir, ship, stored
from tarnflow.llm.tokens import words_of

END = 0


def _encoder(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        tail = np.array([end], words.dtype).tobytes()
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = [i.tobytes() + tail for i in words.encode([t or "" for t in part.column(1).to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _counter(kind: str, symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(symbols, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.column(0).slice(k, 500).cast(pa.large_binary())
                ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset :]
                total += np.bincount(np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[len(part)]].view(kind), minlength=symbols)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["symbol", "n"])

    return run


def _writer(folder: str, kind: str, lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, codes = TaskContext.get(), huffman.canonical(lengths)
        keys, ids, size, rows, number = [], [], 0, [], 0

        def flush() -> None:
            nonlocal keys, ids, size, number
            name = f"{folder}/ids-{context.partitionId():06d}-{number:05d}.huf"
            data = huffman.pack_file(keys, ids, lengths, codes)
            put(name, data, str(context.taskAttemptId()))
            rows.append((context.partitionId(), number, name, len(keys), size, len(data)))
            keys, ids, size, number = [], [], 0, number + 1

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(key)
                ids.append(np.frombuffer(raw, kind))
                size += len(ids[-1])
                if size >= FILE_TOKENS:
                    flush()
        if keys:
            flush()
        names = ["part", "number", "path", "documents", "tokens", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string() if k == 2 else pa.int64()) for k in range(6)], names)

    return run


#: Ids after which a file is closed: what a reader of one file holds. Tasks that read, for each shuffle partition.
FILE_TOKENS, READERS = 2_000_000, 2


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> DataFrame:
    """Write all documents' ids, each with the id `end` after it, in ascending order of doc_id (nulls first, then by the ids) under folder.

    Returns the manifest, in the files' order: part, number, path, documents, tokens, bytes. A null text counts as an empty one, so it
    is the id `end` alone. Rows that share a doc_id all stay. An empty table writes no file. Columns but doc_id and text aren't looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    words = words_of(tokenizer)
    kind, symbols = words.dtype.str, max(words.tokenizer.get_vocab_size(), end + 1)
    staged = stored(docs.select("doc_id", "text").mapInArrow(_encoder(tokenizer, end), "doc_id long, ids binary"), "ids")
    counted = staged.select("ids").mapInArrow(_counter(kind, symbols), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    lengths = huffman.code_lengths({r.symbol: r.n for r in counted.collect()}, symbols)  # a row for each symbol of the vocabulary at most
    order = [F.col("doc_id").asc_nulls_first(), F.col("ids")]
    dealt = staged.repartitionByRange(parts(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(*order)
    return stored(dealt.mapInArrow(_writer(folder, kind, lengths), "part long, number long, path string, documents long, tokens long, bytes long"), "manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, name = filesystem(path)
            with store.open_input_file(name) as f:
                keys, counts, ids = huffman.unpack_file(f.read())
            ends = np.cumsum(counts)
            starts = ends - counts
            raw = ids.astype("<u4")
            sums = [crc(raw[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(before + starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row for each document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The ids before a file are those of earlier parts (a row for each partition that wrote) and of earlier files of its part. A task reads
    its files one after another."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    by_part = manifest.groupBy("part").agg(F.sum("tokens").alias("_all")).select("part", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    listed = manifest.withColumn("_own", F.coalesce(F.sum("tokens").over(own), F.lit(0))).join(by_part, "part").select("path", (F.col("_before") + F.col("_own")).alias("before"))
    return listed.repartition(READERS * parts(spark), "path").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    shared_dir(spark)
    return read(spark, write(docs, scratch(spark, "huffman"), tokenizer))
