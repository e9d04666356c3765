"""What the inverted lists of this subpackage share: texts gathered to blocks, their words numbered, and lists of what stands under a number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[list]]]:
    """(number, columns) of blocks of whole rows, whose first column, of bytes, has about most bytes in all; a longer text is a block of its
    own. Numbers differ over all tasks of a stage."""
    from pyspark import TaskContext

    block, held, rows = TaskContext.get().partitionId() << 32, 0, []
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            for row in zip(*(c.to_pylist() for c in batch.slice(k, 500).columns)):
                if rows and held + len(row[0]) > most:
                    yield block, [list(c) for c in zip(*rows)]
                    block, held, rows = block + 1, 0, []
                rows.append(row)
                held += len(row[0]) + 1
    if rows:
        yield block, [list(c) for c in zip(*rows)]


def words(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, pa.LargeStringArray, np.ndarray]:
    """(starts, distinct words, the number of each word among them): the runs of bytes that are inside a word, A-Z lower-cased."""
    edge = np.zeros(1, np.int8)
    edges = np.diff(np.concatenate([edge, inside.view(np.int8), edge]))  # bytes, as there are as many as of text
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[inside]])).dictionary_encode()
    return starts, found.dictionary, found.indices.to_numpy().astype(np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, distinct keys, offsets): order sorts by key and keeps what is equal as it came; offsets cut it into the groups."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return order, keys[starts], np.append(starts, len(keys)).astype(np.int32)
