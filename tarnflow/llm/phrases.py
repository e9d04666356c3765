"""Phrase collocations mined from vertical positional inverted lists.

Texts are indexed in blocks of whole texts: one row for each word of a block, with the sorted positions at which it stands. Positions of
neighbouring words of a piece differ by one, others by more. A frequent phrase's list is merge-joined, a phrase's length on, with the lists of
the words of its block, which gives the lists of the phrases longer by a word; the length of a phrase's lists over all blocks is its exact
frequency, and only phrases that are frequent go on. Between rounds Spark counts phrases by (prefix, last word) and tells each block which of
its phrases are frequent; positions never leave their block, so that no list of a common word comes together anywhere. Lists of phrases are
grown from the words' again in each round: most phrases are rare, and what is rare need not be kept until that is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.llm.common import SALTS, drop_stored, lookup, ship, stored
from tarnflow.llm.inverted import blocks, grouped, words

#: Bytes of text of a block; a longer text is a block of its own.
BLOCK_BYTES = 12_000_000
UNKNOWN = "und"
# What parts pieces, what parts words within them.
_PARTS_PIECES, _PARTS_WORDS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_PARTS_WORDS)] = 1
_KIND[list(_PARTS_PIECES)] = 2

_LISTS = "block long, code int, lang string, word string, n long, positions array<int>"
_GROWN = "block long, prefix long, last long, n long"


def _lists(keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """(distinct keys, the list of positions of each), positions ascending in each list if they are given so."""
    order, distinct, offsets = grouped(keys)
    return distinct, pa.ListArray.from_arrays(pa.array(offsets), pa.array(positions[order].astype(np.int32)))


def block_lists(texts: list[bytes], langs: list[str]) -> pa.Table:
    """The inverted lists of one block: code (of lang and word), lang, word, n, positions."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = _KIND[data]
    starts, distinct, codes = words(data, kind == 0)
    size = max(len(distinct), 1)
    parted = np.cumsum(kind == 2, dtype=np.int32)[starts]  # separators of pieces before each word
    positions = np.arange(len(starts)) + np.cumsum(np.diff(parted, prepend=parted[:1]) > 0)
    names, lang_codes = np.unique(np.array(langs, dtype=object), return_inverse=True)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    lang_of = lang_codes[np.searchsorted(text_ends, starts, side="right")]
    keys, lists = _lists(lang_of * size + codes, positions)
    return pa.table({
        "code": pa.array(np.arange(len(keys)), pa.int32()), "lang": pa.array(names[keys // size].tolist(), pa.string()),
        "word": distinct.take(pa.array(keys % size)).cast(pa.string()), "n": np.diff(lists.offsets.to_numpy()).astype(np.int64), "positions": lists,
    })


def indexed(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The inverted lists of df's texts: block, code (a word's number there), lang, word, n, positions. Null texts are empty, null lang `und`."""
    ship(df.sparkSession)
    rows = df.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang")).filter(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, (texts, langs) in blocks(batches, BLOCK_BYTES):
            table = block_lists(texts, langs)
            yield from table.add_column(0, "block", pa.array(np.full(table.num_rows, block))).to_batches(50_000)

    return rows.mapInArrow(run, _LISTS)


def _joined(at: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted positions at meet the sorted positions among: the indices of both."""
    if not len(among):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(among, at), len(among) - 1)
    met = np.flatnonzero(among[place] == at)
    return met, place[met]


def _ids(prefix: np.ndarray, last: np.ndarray, frequent: pa.Table) -> np.ndarray:
    """The id of each (prefix, last) among the frequent phrases, or -1. Pairs are distinct on both sides."""
    ids, own = np.full(len(last), -1, np.int64), len(last)
    prefixes, lasts = np.concatenate([prefix, frequent["prefix"].to_numpy()]), np.concatenate([last, frequent["last"].to_numpy()])
    order = np.lexsort((np.arange(len(lasts)), lasts, prefixes))  # a pair comes right before the frequent phrase that it is
    same = (prefixes[order][1:] == prefixes[order][:-1]) & (lasts[order][1:] == lasts[order][:-1])
    ids[order[:-1][same]] = frequent["id"].to_numpy()[order[1:][same] - own]
    return ids


def _grown(length: int):
    """A block's lists of words and its frequent phrases up to a length to its phrases that are longer by a word, with the lengths of their
    lists."""

    def grow(lists: pa.Table, frequent: pa.Table) -> pa.Table:
        of = [frequent.filter(pc.equal(frequent["length"], k)) for k in range(1, length + 1)]
        columns = [c.combine_chunks() for c in (lists["code"], lists["positions"])]
        code, positions = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns)
        # Words and phrases are numbered within the block; names gives their ids, -1 for what isn't frequent.
        words = names = _ids(np.full(len(code), -1, np.int64), code.to_numpy().astype(np.int64), of[0])
        number, at = np.repeat(np.arange(len(code)), np.diff(positions.offsets.to_numpy())), positions.flatten().to_numpy()
        order = np.flatnonzero(names[number] >= 0)
        order = order[np.argsort(at[order], kind="stable")]
        word, word_at = phrase, phrase_at = number[order], at[order]
        for k in range(1, length + 1):
            a, b = _joined(phrase_at + k, word_at)
            head, tail, start = phrase[a], word[b], phrase_at[a]
            if k > 1:  # the rest of the longer phrase must be frequent too, and so stands among the phrases of this length
                rest, _ = _joined(start + 1, phrase_at)
                head, tail, start = head[rest], tail[rest], start[rest]
            size = max(len(words), 1)
            keys, which, n = np.unique(head * size + tail, return_inverse=True, return_counts=True)
            prefix, last = names[keys // size], words[keys % size]
            if k < length:
                names = _ids(prefix, last, of[k])
                kept = np.flatnonzero(names[which] >= 0)
                phrase, phrase_at = which[kept], start[kept]
        block = (lists if lists.num_rows else frequent)["block"][0].as_py()
        return pa.table({"block": np.full(len(keys), block, np.int64), "prefix": prefix, "last": last, "n": n.astype(np.int64)})

    return grow


class Mined:
    """Frequent words and phrases: levels[k] has id, prefix (the id of the phrase without its last word), last (a word's id), a; words has id,
    lang, word, a; totals has lang, n."""

    def __init__(self, words: DataFrame, levels: dict[int, DataFrame], totals: DataFrame, scratch: list[DataFrame]):
        self.words, self.levels, self.totals, self._scratch = words, levels, totals, scratch

    def drop(self) -> None:
        for df in [*self._scratch, self.words, *self.levels.values(), self.totals]:
            drop_stored(df)


def mined(df: DataFrame, most_words: int = 3, least: int = 10, text: str = "text", lang: str = "lang") -> Mined:
    """All phrases of 2 to most_words words with least occurrences or more in a language, by rounds of lists grown by a word."""
    lists = stored(indexed(df, text, lang), "lists")
    counts = stored(lists.groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = stored(counts.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    frequent_words = stored(counts.filter(F.col("a") >= least).withColumn("id", F.monotonically_increasing_id()), "frequent-words")
    # A word has one row a block at most, so no key of this join is hot. The block's own code stands for the word from here.
    known = lists.select("block", "code", "lang", "word").join(frequent_words.select("lang", "word", "id"), ["lang", "word"])
    frequent = stored(known.select("block", F.lit(1).alias("length"), F.lit(-1).cast("long").alias("prefix"), F.col("code").cast("long").alias("last"), "id"), "known")
    scratch, levels, positions = [lists, counts, frequent], {}, lists.select("block", "code", "positions")
    for length in range(1, most_words):
        grown = positions.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(_grown(length), _GROWN)
        if length + 1 == most_words:
            level = grown.groupBy("prefix", "last").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
        else:  # counts come to the rows of all blocks by one shuffle; a phrase has one row a block
            over = Window.partitionBy("prefix", "last")
            counted = grown.withColumn("a", F.sum("n").over(over)).withColumn("first", F.min("block").over(over) == F.col("block")).filter(F.col("a") >= least)
            scratch.append(counted := stored(counted.drop("n"), f"phrases-{length + 1}"))
            level = counted.filter("first").select("prefix", "last", "a")
        levels[length + 1] = level = stored(level.withColumn("id", F.monotonically_increasing_id()), f"frequent-{length + 1}")
        if length + 1 < most_words:
            found = counted.select("block", F.lit(length + 1).alias("length"), "prefix", "last").join(level.select("prefix", "last", "id"), ["prefix", "last"])
            frequent = frequent.unionByName(found.select("block", "length", "prefix", "last", "id"))
    return Mined(frequent_words, levels, totals, scratch)


def collocations(df: DataFrame, top: int = 2000, least: int = 10, share: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first phrases of 2 and 3 words of each language: lang, rank, phrase, a, l, r, n, score.

    A null text is empty; a null lang is `und`, together with rows that say so; repeated rows count each time; an empty table gives no row.
    Ties go by a, then by the phrase's bytes. A phrase is dropped whose words stand in a longer one with share hundredths of its count. The
    product of counts is a decimal of 38 digits, exact up to counts of 10**16.
    """
    m = mined(df, 3, least, text, lang)
    exact = F.expr("cast((cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) as long)")

    def name(p: str, *more: str) -> DataFrame:
        return m.words.select(F.col("id").alias(p), F.col("word").alias(f"word_{p}"), F.col("a").alias(f"a_{p}"), *more)

    two = m.levels[2].withColumnRenamed("prefix", "w1").withColumnRenamed("last", "w2")
    two = lookup(lookup(two, "w1", name("w1", "lang"), "id"), "w2", name("w2"), "id")
    pairs = stored(two.select("id", "w1", "w2", "lang", F.concat_ws(" ", "word_w1", "word_w2").alias("phrase"), "a", F.col("a_w1").alias("l"), F.col("a_w2").alias("r")), "pairs")
    three = m.levels[3].select(F.col("id").alias("id3"), F.col("prefix").alias("id"), F.col("last").alias("w3"), "a")
    heads = pairs.select("id", "w2", "lang", F.col("phrase").alias("head"), F.col("a").alias("a_12"), F.col("l").alias("a_1"))
    three = lookup(lookup(three, "id", heads, "id3"), "w3", name("w3"), "id3").withColumnRenamed("id", "head_id")
    # The last two words are a pair of the same language; its key is (w2, w3), one row each.
    tails = pairs.select(F.struct(F.col("w1"), F.col("w2")).alias("pair"), F.col("id").alias("tail_id"), F.col("a").alias("a_23"))
    three = lookup(three.withColumn("pair", F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))), "pair", tails, "id3")
    triples = stored(three.select("lang", F.concat_ws(" ", "head", "word_w3").alias("phrase"), "a", "head_id", "tail_id", "a_1", "a_23", "a_12", F.col("a_w3").alias("a_3")), "triples")
    cuts = triples.select("lang", "phrase", "a", F.explode(F.array(
        F.struct(F.lit(1).alias("k"), F.col("a_1").alias("l"), F.col("a_23").alias("r")), F.struct(F.lit(2).alias("k"), F.col("a_12").alias("l"), F.col("a_3").alias("r"))
    )).alias("cut")).select("lang", "phrase", "a", "cut.*").withColumn("score", exact)
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    covers = triples.select(F.explode(F.array("head_id", "tail_id")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longer"))
    kept = pairs.join(covers, "id", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    found = scored.unionByName(kept.select("lang", "phrase", "a", "l", "r").withColumn("score", exact))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    out = stored(ranked.join(m.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    m.drop()
    drop_stored(pairs)
    drop_stored(triples)
    return out
