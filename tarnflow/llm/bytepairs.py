"""Byte-level BPE by ranks, contracted and decoded by DuckDB's recursive and ordered queries inside Spark's tasks.

A batch's new words become rows (word, position, token). Each round of a recursive query joins neighbours with the merge table, takes every
word's least rank and contracts its leftmost pair of that rank, until no word has a pair left. Decoding joins rows (document, position, id)
with the vocabulary and orders them, so that the pieces' bytes follow each other as in the documents.

In long words a round contracts all pairs of the least rank at once, leftmost first, where ranks only rise while a word is contracted: pairs
of a lower rank never come up then, so one at a time would give the same. Whether they do is a property of the vocabulary and is found out for
each one (`rising`): a pair that comes up spans the bytes of one token, whose ends were ends all along, so it came up when that token's own
bytes were contracted too, and these are all looked at. Where ranks may fall, long words too are contracted by one pair a round.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tarnflow.llm.common import ship
from tarnflow.llm.tokens import Recent

#: Characters of text taken at a time, those of the new words of one recursive query, ids taken at a time, words kept by a worker, rounds of
#: one recursive query (its rows all stay until it ends), bytes of a word up to which one pair is contracted a round (a cheaper query; over
#: that it would take a round for each byte).
CHARS, WORD_CHARS, IDS, KEPT, ROUNDS, SHORT = 2_000_000, 300_000, 300_000, 500_000, 48, 256

#: Each word's leftmost pair of its least rank.
_ONE = f"""
with recursive state(word, round, last, fell, more, pos, id) as (
    select word, 0, last, fell, true, pos, id from tokens
    union all
    select word, round + 1, coalesce((least >> 32)::int, last), fell or coalesce((least >> 32) < last, false), least is not null, pos,
        case when key = least then merged else id end
    from (
        with pairs as (
            select s.*, m.merged, (m.merged::bigint << 32) + s.pos as key
            from (
                select *, lead(id) over v as next, lead(word) over v as next_word, lag(pos) over v as before from state where more and round < {ROUNDS}
                window v as (order by pos)
            ) s left join merges m on s.next_word = s.word and m.a = s.id and m.b = s.next
        )
        select pairs.*, least from pairs join (select word, min(key) as least from pairs group by word) using (word)
    ) where least is null or before is null or before <> (least & 4294967295)
)
select word, last, fell, more, pos, id from state where not more or round = {ROUNDS}
"""
#: Each word's pairs of its least rank, of neighbouring ones every second from the left.
_ALL = f"""
with recursive state(word, round, last, fell, more, pos, id) as (
    select word, 0, last, fell, true, pos, id from tokens
    union all
    select word, round + 1, coalesce(least, last), fell, least is not null, pos, case when taken then merged else id end
    from (
        select *, coalesce(lag(taken) over w, false) as eaten
        from (
            select *, coalesce(merged = least and row_number() over (partition by word, merged = least, nth - hit order by nth) % 2 = 1, false) as taken
            from (select *, row_number() over (partition by word, merged = least order by nth) as hit from (
                select s.*, m.merged, min(m.merged) over (partition by word) as least
                from (
                    select *, lead(id) over v as next, row_number() over v as nth from state where more and round < {ROUNDS}
                    window v as (partition by word order by pos)
                ) s left join merges m on m.a = s.id and m.b = s.next
            ))
        ) window w as (partition by word order by nth)
    ) where not eaten
)
select word, last, fell, more, pos, id from state where not more or round = {ROUNDS}
"""


def ranks(data: bytes) -> list[bytes]:
    """Tokens by rank, of a file of lines 'base64 rank'; ranks must be 0, 1, 2 and so on, and hold all single bytes."""
    rows = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()))
    if [r for r, _ in rows] != list(range(len(rows))):
        raise ValueError("ranks must be 0, 1, 2 and so on")
    tokens = [token for _, token in rows]
    if missing := {bytes([i]) for i in range(256)}.difference(tokens):
        raise ValueError(f"{len(missing)} single bytes have no rank")
    return tokens


class Merges:
    """A vocabulary in a DuckDB connection of its own: tables vocabulary (id, piece) and merges (a, b, merged), one row for each way to cut
    a token into two tokens."""

    def __init__(self, tokens: list[bytes], rising: bool | None = None):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.tokens, self.known = tokens, Recent(KEPT)
        self._table("vocabulary", pa.table({"id": pa.array(range(len(tokens)), pa.int32()), "piece": pa.array(tokens, pa.binary())}))
        self.rising = self._rises() if rising is None else rising

    @cached_property
    def whole(self) -> dict[bytes, int]:
        return {token: i for i, token in enumerate(self.tokens)}

    @cached_property
    def single(self) -> np.ndarray:
        """The tokens of single bytes; the merge table is made with them."""
        ids = self.whole
        cuts = np.array([(ids[t[:k]], ids[t[k:]], i) for i, t in enumerate(self.tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids], np.int32).reshape(-1, 3)
        self._table("merges", pa.table({"a": cuts[:, 0], "b": cuts[:, 1], "merged": cuts[:, 2]}))
        return np.array([ids[bytes([i])] for i in range(256)], np.int32)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"create or replace table {name} as select * from given")
        self.con.unregister("given")

    def contracted(self, words: list[bytes], one: bool = True) -> pa.Table:
        """Rows (word: its number, ids: its tokens in order, fell: whether a rank came up below an earlier one, where one pair is contracted a
        round) for words of a byte or more."""
        lengths = np.array([len(w) for w in words], np.int64)
        n = int(lengths.sum())
        tokens = pa.table({
            "word": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "last": np.full(n, -1, np.int32), "fell": np.zeros(n, bool),
            "pos": np.arange(n, dtype=np.int32), "id": self.single[np.frombuffer(b"".join(words), np.uint8)],
        })
        done = []
        while tokens.num_rows:
            self._table("tokens", tokens)
            self.con.execute(f"create or replace temp table ended as {_ONE if one else _ALL}")
            done.append(self.con.sql("select word, list(id order by pos) as ids, bool_or(fell) as fell from ended where not more group by word").to_arrow_table())
            tokens = self.con.sql("select word, last, fell, pos, id from ended where more").to_arrow_table()
        return pa.concat_tables(done)

    def _rises(self) -> bool:
        """Whether ranks only rise while any token's own bytes are contracted, one pair after the other."""
        longer = [t for t in self.tokens if len(t) > 1]
        if not longer:
            return True
        ended = self.contracted(longer)
        return not any(fell and len(ids) == 1 for fell, ids in zip(ended["fell"].to_pylist(), ended["ids"].to_pylist()))

    def encoded(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words. A word that is a token of its own is that token, whatever its contraction gives; words are kept when first met."""
        short: list[str] = []
        long: list[str] = []
        new, found = self.known.missing(words), self.known.young
        for w in new:
            data = w.encode()
            if (i := self.whole.get(data)) is not None:
                found[w] = np.uint32(i).tobytes()
            else:
                (long if self.rising and len(data) > SHORT else short).append(w)
        for part, one in ((short, True), (long, False)):
            for low, high in _slices(np.array([len(w) for w in part]), WORD_CHARS):
                self._read(part[low:high], self.contracted([w.encode() for w in part[low:high]], one), found)
        return dict(zip(words, map(found.__getitem__, words)))  # noqa: B905

    def _read(self, words: list[str], ended: pa.Table, found: dict[str, bytes]) -> None:
        ids = ended["ids"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        flat, cuts = ids.values.to_numpy().astype("<u4").tobytes(), ids.offsets.to_pylist()
        for word, low, high in zip(ended["word"].to_pylist(), cuts[:-1], cuts[1:]):
            found[words[word]] = flat[4 * low : 4 * high]

    def decoded(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, pa.Buffer, np.ndarray]:
        """(owners, bytes, ends of each owner's bytes): ids are put together by owner in their order. An id that isn't in the vocabulary is an
        error."""
        self.con.register("given", pa.table({"owner": owner, "pos": np.arange(len(ids), dtype=np.int32), "id": ids}))
        found = self.con.sql("select piece from given join vocabulary using (id) order by owner, pos").to_arrow_table().combine_chunks()
        self.con.unregister("given")
        if found.num_rows != len(ids):
            raise ValueError("an id is not in the vocabulary")
        if not found.num_rows:
            return np.zeros(0, owner.dtype), pa.py_buffer(b""), np.zeros(1, np.int64)
        # In this order the pieces' bytes are those of the owners.
        pieces = found["piece"].chunk(0)
        owners, counts = np.unique(owner, return_counts=True)
        offsets = np.frombuffer(pieces.buffers()[1], np.int64 if pa.types.is_large_binary(pieces.type) else np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        return owners, pieces.buffers()[2], offsets[np.append(0, np.cumsum(counts))].astype(np.int64)


@lru_cache(2)
def _known(tokens: bytes, rising: bool) -> Merges:
    return Merges(ranks(tokens), rising)


@lru_cache(4)
def rises(data: bytes) -> bool:
    return Merges(ranks(data)).rising


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about most together, one row at least."""
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _schema(df: DataFrame, name: str) -> tuple[list[str], str]:
    kept = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    return [f.name for f in kept], ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{name}` binary"])


def encoded(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with its texts' ids, little-endian and 32 bits each, as a binary column. vocabulary: a file 'base64 rank' a line; each match of
    pattern is a word of its own.

    A null text has null ids and an empty one empty ids; repeated rows stay; a column that is called like ids is replaced. Texts are taken
    whole. Special tokens aren't looked for. One task holds about CHARS characters, or one text, at a time.
    """
    spark = df.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as file:
        data = file.read()
    rising, (names, schema) = rises(data), _schema(df, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        merges, words_of = _known(data, rising), regex.compile(pattern).findall
        for batch in batches:
            texts = batch.column(text)
            for low, high in _slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), CHARS):
                words = [None if t is None else words_of(t) for t in texts.slice(low, high - low).to_pylist()]
                get = merges.encoded(set().union(*filter(None, words))).__getitem__
                made = pa.array([None if w is None else b"".join(map(get, w)) for w in words], pa.binary())
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), made], [*names, ids])

    return df.mapInArrow(run, schema)


def decoded(df: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the bytes that ids (as encoded() gives them) stand for, as a binary column; they need not be UTF-8.

    Null ids give null, empty ones nothing; repeated rows stay; a column that is called like into is replaced. An id outside the vocabulary
    is an error. One task holds the rows of about IDS ids, or one row, at a time, and DuckDB IDS rows at most.
    """
    spark = df.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as file:
        data = file.read()
    names, schema = _schema(df, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _known(data, True)
        for batch in batches:
            for low, high in _slices(pc.fill_null(pc.binary_length(batch.column(ids)), 0).to_numpy() // 4, IDS):
                rows = batch.slice(low, high - low)
                given = rows.column(ids).to_pylist()
                flat = np.frombuffer(b"".join(x or b"" for x in given), "<u4").astype(np.int32)
                owner = np.repeat(np.arange(len(given), dtype=np.int32), [len(x or b"") // 4 for x in given])
                found: list[list[bytes]] = [[] for _ in given]
                for start in range(0, len(flat), IDS):
                    owners, bytes_, ends = merges.decoded(flat[start : start + IDS], owner[start : start + IDS])
                    view = memoryview(bytes_)
                    for o, a, b in zip(owners.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                        found[o].append(bytes(view[a:b]))
                made = pa.array([None if x is None else b"".join(f) for x, f in zip(given, found)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), made], [*names, into])

    return df.mapInArrow(run, schema)
