"""Ranked lexical search by a threshold-seeded join over stored inverted lists.

The index holds, for each term, its document count, its weight, and the K documents of its greatest impacts; the least of these is the term's
kth impact. For an item they give a score that its kth best document reaches at least: a term's kth impact alone, or the kth best of the
documents on its terms' lists by what the lists say. An item's terms are put in order of the most that they can add, and those at the end
that cannot reach the threshold together are left out: a document that holds nothing else cannot be among the best. The others' lists make
candidates, of which those stay that could still reach the threshold; what the terms left out add to these is looked up, which makes their
scores exact. Lists are kept by blocks of whole texts, so that all this happens within a block, and only its best documents leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.llm.common import drop_stored, lookup, ship, stored
from tarnflow.llm.inverted import blocks, grouped, words

#: Bytes of text of a block, those whose words are numbered at a time, and best documents kept for each term.
BLOCK_BYTES, SLICE_BYTES, K = 24_000_000, 3_000_000, 10
# Bytes of terms are digits, letters and all above 127; the score's constants.
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LENGTH_SHARE, _SCALE, _TF, _NORM = 75, 1_000_000_000, 1000, 8

_LISTS = "term string, block long, docs array<long>, tfs array<int>, ns array<int>"
#: Items whose lists are met in one task for each block.
ITEMS = 1000


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of SLICE_BYTES at most, one text at least."""
    start = held = 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    yield start, len(texts)


def block_lists(texts: list[bytes], keys: list[int]) -> tuple[pa.Table, np.ndarray]:
    """(lists by term, texts with a term): lists name texts by their keys; under the empty term stand all texts that have a term, with its
    count of terms."""
    n, parts = np.zeros(len(texts), np.int32), []
    for low, high in _slices(texts):
        data = np.frombuffer(b" ".join(texts[low:high]), np.uint8)
        starts, distinct, codes = words(data, _TERM[data])
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[low:high]]), starts, side="right")
        n[low:high] = np.bincount(doc, minlength=high - low)
        found, tf = np.unique(codes * (high - low) + doc, return_counts=True)
        parts.append((distinct, (found // (high - low)).astype(np.int32), (found % (high - low) + low).astype(np.int32), tf.astype(np.int32)))
    del data, starts, codes, found
    # The slices' words numbered over the block; its texts ascend within a word, as slices do.
    all_words = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    distinct, numbers, ends = all_words.dictionary, all_words.indices.to_numpy(), np.cumsum([0, *[len(p[0]) for p in parts]])
    codes = np.concatenate([numbers[b:e][p[1]] for p, b, e in zip(parts, ends[:-1], ends[1:])])
    doc, tf = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
    del parts
    order, at, offsets = grouped(codes)
    doc, tf = doc[order], tf[order]
    some = np.flatnonzero(n)
    docs, tfs, ns = np.array(keys, np.int64)[np.concatenate([doc, some])], np.concatenate([tf, n[some]]), np.concatenate([n[doc], n[some]])
    offsets = pa.array(np.append(offsets, len(docs)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (docs, tfs, ns)]
    return pa.table([pa.concat_arrays([distinct.take(pa.array(at)).cast(pa.string()), pa.array([""])]), *lists], ["term", "docs", "tfs", "ns"]), some


def lists_of(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """The inverted lists of df's texts by block. Texts are numbered (the numbers ascend within a block by id, missing ones last, then as the
    rows come); under the empty term stand all that have a term, with `ids` beside, which is null elsewhere."""
    ship(df.sparkSession)
    rows = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"), F.col(id_column).alias("id")).filter(F.length("text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, first = None, None

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("id").type
                yield batch

        for block, (texts, ids) in blocks(noted(), BLOCK_BYTES):
            first = block if first is None else first
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            ids = [ids[i] for i in order]
            table, some = block_lists([texts[i] for i in order], range(first, first + len(ids)))
            del texts
            first += len(ids)
            named = pa.array([*[None] * (table.num_rows - 1), [ids[i] for i in some]], pa.list_(kind))
            yield from table.add_column(1, "block", pa.array(np.full(table.num_rows, block))).append_column("ids", named).to_batches(50_000)
            del table, named
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, f"{_LISTS}, ids array<{rows.schema['id'].dataType.simpleString()}>")


def named(lists: DataFrame) -> DataFrame:
    """(key, id) of the texts of lists."""
    return lists.filter(F.col("term") == "").select(F.explode(F.arrays_zip("docs", "ids")).alias("p")).select(F.col("p.docs").alias("key"), F.col("p.ids").alias("id"))


def impacts(tfs: np.ndarray, ns: np.ndarray, texts: int, length: int) -> np.ndarray:
    """What a term adds to a text's score for each unit of its weight, in 64-bit integers."""
    tf, n = tfs.astype(np.int64), ns.astype(np.int64)
    return (_SCALE * tf) // (_TF * tf + _NORM * (100 - _LENGTH_SHARE + (_LENGTH_SHARE * n * texts) // max(length, 1)))


def _cut(term: pa.Array, df: np.ndarray, row: np.ndarray, doc: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
    """One row for each run of equal terms: df summed, and the k entries of greatest impact. row: each entry's row."""
    new = np.concatenate([[True], pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)]) if len(term) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    of = run[row]
    order = np.lexsort((doc, -q, of))
    sizes = np.bincount(of, minlength=run[-1] + 1 if len(run) else 0)
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = order[place < k]
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.minimum(sizes, k))]).astype(np.int32))
    total = np.add.reduceat(df, np.flatnonzero(new)) if len(df) else df
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[kept])) for x in (doc, q)]
    return pa.RecordBatch.from_arrays([term.filter(pa.array(new)), pa.array(total), *lists], ["term", "df", "docs", "qs"])


def _entries(lists: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def _best(texts: int, length: int, k: int):
    """Each list cut to its k texts of greatest impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tfs, ns = (batch.column(c) for c in ("docs", "tfs", "ns"))
            df = np.diff(docs.offsets.to_numpy()).astype(np.int64)
            yield _cut(batch.column("term"), df, _entries(docs), docs.flatten().to_numpy(), impacts(tfs.flatten().to_numpy(), ns.flatten().to_numpy(), texts, length), k)

    return run


def _merged(k: int):
    """The cut lists of a term, which follow each other, made one. The last term of a batch waits, cut, for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if waiting is None else [waiting, batch.cast(waiting.schema)]).combine_chunks()
            term, df, docs, qs = (c.chunk(0) for c in table.columns)
            cut = _cut(term, df.to_numpy(), _entries(docs), docs.flatten().to_numpy(), qs.flatten().to_numpy(), k)
            yield cut.slice(0, cut.num_rows - 1)
            waiting = pa.Table.from_batches([cut.slice(cut.num_rows - 1)]).take([0]).combine_chunks().to_batches()[0]
        if waiting is not None:
            yield waiting

    return run


class Index:
    """A stored index of texts: lists by term and block, terms (term, df, w, kth, most, docs and qs: its best texts and their impacts), and the
    numbers of texts with a term and of their terms."""

    def __init__(self, lists: DataFrame, terms: DataFrame, texts: int, length: int, k: int):
        self.lists, self.terms, self.texts, self.length, self.k = lists, terms, texts, length, k

    def drop(self) -> None:
        drop_stored(self.lists)
        drop_stored(self.terms)


def indexed(df: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = K) -> Index:
    """The index of a table of documents. Null and empty texts have no term; each row is a document of its own, whatever its id."""
    lists = stored(lists_of(df, id_column, text), "lists")
    found = lists.filter(F.col("term") == "").select(F.sum(F.size("docs")).alias("texts"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("length")).first()
    texts, length = found.texts or 0, found.length or 0
    schema = "term string, df long, docs array<long>, qs array<long>"
    cut = lists.filter(F.col("term") != "").select("term", "docs", "tfs", "ns").mapInArrow(_best(texts, length, k), schema)
    # A term has a row a block at most, and what a task holds of it is cut to k.
    best = cut.repartition("term").sortWithinPartitions("term").mapInArrow(_merged(k), schema)
    w = F.floor(1000 * F.log((2 * F.lit(texts) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    kth = F.when(F.size("qs") == k, F.element_at("qs", -1)).otherwise(0)
    terms = best.select("term", "df", w.alias("w"), "docs", "qs").select("term", "df", "w", (F.col("w") * kth).alias("kth"), (F.col("w") * F.element_at("qs", 1)).alias("most"), "docs", "qs")
    return Index(lists, stored(terms, "terms"), texts, length, k)


def _scored(texts: int, length: int, k: int):
    """A block's lists of the terms that items ask for, to the block's best documents of each item: those that the terms needed lead to, with
    what the terms left out add."""

    def score(lists: pa.Table) -> pa.Table:
        lists = lists.combine_chunks()
        docs, tfs, ns, askers = (lists[c].chunk(0) for c in ("docs", "tfs", "ns", "askers"))
        keys, local = np.unique(docs.flatten().to_numpy(), return_inverse=True)
        q, cuts = impacts(tfs.flatten().to_numpy(), ns.flatten().to_numpy(), texts, length), docs.offsets.to_numpy() - docs.offsets[0].as_py()
        asked = askers.flatten()
        item, cw, needed, want = (asked.field(c).to_numpy(zero_copy_only=False) for c in ("item", "cw", "needed", "want"))
        row = _entries(askers)
        order, items, ends = grouped(item)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, name in enumerate(items):
            mine = order[ends[i] : ends[i + 1]]
            score = np.zeros(len(keys), np.int64)
            for j in mine[needed[mine]]:
                span = slice(cuts[row[j]], cuts[row[j] + 1])
                score[local[span]] += cw[j] * q[span]
            met = np.flatnonzero((score >= want[mine[0]]) & (score > 0))
            if not len(met):
                continue
            total = score[met]
            for j in mine[~needed[mine]]:
                span = slice(cuts[row[j]], cuts[row[j] + 1])
                at = np.minimum(np.searchsorted(local[span], met), cuts[row[j] + 1] - cuts[row[j]] - 1)
                total += np.where(local[span][at] == met, cw[j] * q[span][at], 0)
            first = np.lexsort((met, -total))[:k]
            out.append((np.full(len(first), name), keys[met[first]], total[first]))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(columns, ["item", "doc", "score"])

    return score


def search(index: Index, items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """The index.k best documents of each item, one row of items each: item, rank, doc, score; item and doc are the ids given.

    Scores are over 0; equal ones go by id, a missing id last, then by the order of the rows. An item without text, or whose terms no document
    holds, has no row; items with one id are ranked each on its own. ITEMS items meet a block in one task.
    """
    k = index.k
    asking = stored(lists_of(items, id_column, text), "items")
    asked = asking.filter(F.col("term") != "").select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("p")).select("term", F.col("p.docs").alias("item"), F.col("p.tfs").cast("long").alias("c"))
    known = stored(lookup(asked, "term", index.terms.filter(F.col("w") > 0), "item").withColumn("cw", F.expr("c * w")), "item-terms")
    # Two lower bounds of an item's kth score: its terms' kth impacts, and what their best documents get from these lists alone.
    alone = known.groupBy("item").agg(F.max(F.expr("c * kth")).alias("alone"))
    together = known.select("item", "cw", F.explode(F.arrays_zip("docs", "qs")).alias("b")).groupBy("item", F.col("b.docs").alias("doc")).agg(F.sum(F.col("cw") * F.col("b.qs")).alias("part"))
    together = together.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("part")))).filter(F.col("place") <= k).groupBy("item").agg(F.min(F.when(F.col("place") == k, F.col("part"))).alias("together"))
    least = alone.join(together, "item").select("item", F.greatest("alone", F.coalesce("together", F.lit(0))).alias("least"))
    # Terms that cannot reach the threshold together are left out, those that add least first.
    last = Window.partitionBy("item").orderBy(F.asc(F.expr("c * most")), F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    bounded = known.withColumn("reach", F.sum(F.expr("c * most")).over(last)).join(least, "item").withColumn("needed", F.col("reach") >= F.col("least"))
    rest = F.coalesce(F.sum(F.when(~F.col("needed"), F.expr("c * most"))).over(Window.partitionBy("item")), F.lit(0))
    bounded = bounded.withColumn("want", F.col("least") - rest).withColumn("part", F.pmod(F.xxhash64("item"), F.lit(-(-named(asking).count() // ITEMS) or 1)))
    askers = stored(bounded.groupBy("term", "part").agg(F.collect_list(F.struct("item", "cw", "needed", "want")).alias("askers")), "askers")
    met = lookup(index.lists.filter(F.col("term") != "").drop("ids"), "term", askers, "block").select("block", "part", "docs", "tfs", "ns", "askers")
    scores = met.groupBy("block", "part").applyInArrow(_scored(index.texts, index.length, k), "item long, doc long, score long")
    scores = stored(scores, "scores").join(named(index.lists).select(F.col("key").alias("doc"), F.col("id").alias("doc_id")), "doc")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc"))
    ranked = scores.withColumn("rank", place).filter(F.col("rank") <= k)
    out = stored(ranked.join(named(asking).select(F.col("key").alias("item"), F.col("id").alias("item_id")), "item").select(F.col("item_id").alias("item"), "rank", F.col("doc_id").alias("doc"), "score"), "ranked")
    for df in (asking, known, askers):
        drop_stored(df)
    return out
