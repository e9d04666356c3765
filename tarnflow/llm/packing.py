"""Packing: bounded-space online best fit. Each partition keeps a fixed number of open windows; leftovers are merged at the end."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import crc, ship, stored
from tarnflow.llm.tokens import words_of

WIDTH, OPEN, END = 2048, 256, 1
#: Windows left over by this many partitions meet in one task of the merge: OPEN times as many windows at most, whatever the input.
MERGED_PARTITIONS = 16

PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [T.StructField("left_over", T.BooleanType())])


class Windows:
    """Open windows, at most `most`, by the room that they have left. put() gives those that it had to close."""

    def __init__(self, width: int = WIDTH, most: int = OPEN):
        self.width, self.most = width, most
        self.rooms: list[tuple[int, int]] = []  # (room, number), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def put(self, item, length: int) -> list | None:
        """Place item where the least room is left over; with no such window open a new one, closing the fullest if there are too many."""
        closed = None
        at = bisect_right(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, number = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.most:
                closed = self.held.pop(self.rooms.pop(0)[1])
            room, number = self.width, self.made
            self.made += 1
            self.held[number] = []
        self.held[number].append(item)
        if room == length:
            # A full window leaves at once and makes no room for another to close: both may happen in one call only if closed is None here.
            full = self.held.pop(number)
            return full if closed is None else [*closed, None, *full]
        insort(self.rooms, (room - length, number))
        return closed

    def rest(self) -> list[list]:
        """The open windows, fullest first."""
        out = [self.held[n] for _, n in self.rooms]
        self.rooms, self.held = [], {}
        return out


def _split(closed: list) -> list[list]:
    if None not in closed:
        return [closed]
    k = closed.index(None)
    return [closed[:k], closed[k + 1 :]]


def _packer(tokenizer: str, width: int, most: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = words_of(tokenizer), Windows(width, most)
        first, number, rows = TaskContext.get().partitionId() << 36, 0, []

        def close(window: list, left_over: bool) -> None:
            nonlocal number
            offset = 0
            for doc_id, start, length, check, tokens in window:
                rows.append((doc_id, start, length, check, tokens, first + number, offset, left_over))
                offset += length
            number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(PIECES)
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "left_over" else pa.int64()) for c, n in zip(columns, PIECES.names, strict=True)], PIECES.names)
            rows.clear()
            return made

        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                ids = words.encode([t or "" for t in part.column(1).to_pylist()])
                for doc_id, own in zip(part.column(0).to_pylist(), ids, strict=True):
                    raw = np.append(own, own.dtype.type(end)).astype("<u4")
                    # Whole windows first: the rest of a document stays in one piece.
                    for start in range(0, len(raw), width):
                        piece = raw[start : start + width]
                        item = (doc_id, start, len(piece), crc(piece.tobytes()), len(raw))
                        if len(piece) == width:
                            close([item], False)
                        elif closed := windows.put(item, len(piece)):
                            for window in _split(closed):
                                close(window, False)
                yield out()
        for window in windows.rest():
            close(window, True)
        yield out()

    return run


def _merger(width: int, most: int):
    """Best fit, longest first, over what is left in the windows of some partitions; only pieces move, none is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def merged() -> pa.RecordBatch:
            windows, closed = Windows(width, max(1, len(rows))), []
            number = min(r[5] for r in rows)
            for r in sorted(rows, key=lambda r: (-r[2], r[5], r[6])):
                if full := windows.put(r, r[2]):
                    closed += _split(full)
            out = []
            for k, window in enumerate([*closed, *windows.rest()]):
                offset = 0
                for r in window:
                    out.append((*r[:5], number + (1 << 35) + k, offset, True))
                    offset += r[2]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "left_over" else pa.int64()) for c, n in zip(zip(*out, strict=True), PIECES.names, strict=True)], PIECES.names)

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[0] != group and rows:
                    yield merged()
                    rows = []
                group = r[0]
                rows.append(r[1:])
        if rows:
            yield merged()

    return run


def packed(docs: DataFrame, tokenizer: str, width: int = WIDTH, most: int = OPEN, end: int = END) -> DataFrame:
    """Pack all documents' ids, each with the id `end` after it, into sequences of at most width ids.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null text counts as an empty one and gives
    the id `end` alone. A document longer than width is cut every width ids; only its rest shares a sequence. Rows that share a doc_id are
    packed each for itself, a null doc_id stays null, an empty table gives no row. Columns but doc_id and text aren't looked at. A partition
    holds `most` open windows, so memory doesn't grow with it; what is open at its end is packed again with the same of its neighbours.
    """
    spark = docs.sparkSession
    ship(spark)
    placed = stored(docs.select("doc_id", "text").mapInArrow(_packer(tokenizer, width, most, end), PIECES), "pieces")
    names = PIECES.names
    open_rows = placed.filter("left_over").withColumn("_group", F.shiftright("sequence_id", 36).cast("long") - F.pmod(F.shiftright("sequence_id", 36), F.lit(MERGED_PARTITIONS)))
    merged = open_rows.repartition("_group").sortWithinPartitions("_group", "sequence_id", "offset").select("_group", *names).mapInArrow(_merger(width, most), PIECES)
    return placed.filter("not left_over").unionByName(merged).drop("left_over")
