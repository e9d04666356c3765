"""Language ID: known words by their log frequency in each language, unseen words by backing off to ever shorter character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import drop_stored, let_go, ship, stored

#: The classifier is fitted on a sample of labelled documents, chosen by a hash of doc_id and text: about so many documents and characters of each
#: language at most, and so many characters of all. Every word and n-gram of the sample is kept, so these bound the model too.
SAMPLE_DOCS, SAMPLE_CHARS, ALL_CHARS = 2_000, 8_000_000, 100_000_000
LONGEST = 4
#: Words of a document that count as independent evidence at most; the score says how sure that many are.
EVIDENCE = 20
#: Bytes of the vectors of unseen words that a worker keeps; a word takes about so many, and 8 for each language.
CACHE_BYTES, WORD_BYTES = 32_000_000, 270
#: Rows of a batch that are looked at in one go.
SLICE_ROWS = 500
UNKNOWN = "und"


def _letters() -> str:
    """The ranges of letters and marks; what is unassigned between two of them joins them."""
    ranges: list[list[int]] = []
    gap = True
    for code in (*range(0x32400), *range(0xE0100, 0xE01F0)):  # no others are assigned
        kind = unicodedata.category(chr(code))
        if kind[0] in "LM":
            if gap:
                ranges.append([code, code])
            ranges[-1][1], gap = code, False
        elif kind != "Cn":
            gap = True
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges)


_WORD = re.compile(f"[{_letters()}]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text, for learning and for prediction: runs of letters and marks, lower case, composed. None where there is no letter."""
    found = _WORD.findall(unicodedata.normalize("NFC", text.lower())) if text else []
    return found if any(map(str.isalpha, found)) or any(c.isalpha() for w in found for c in w) else []


def held_out(doc_id: Column) -> Column:
    """The documents that a model may not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Frequencies:
    """Log frequencies of items in each language with add-half smoothing: what an item that a language lacks has there (base), and what an
    item that it has gains over that, kept for those pairs alone."""

    def __init__(self, languages: list[str], langs: list[str], items: list[str], counts: list[int]):
        column = {x: k for k, x in enumerate(languages)}
        self.index: dict[str, int] = {}
        rows = np.array([self.index.setdefault(i, len(self.index)) for i in items], np.int64)
        cols, n = np.array([column[x] for x in langs], np.int64), np.array(counts, np.float64)
        order = np.lexsort((cols, rows))
        rows, self.columns, n = rows[order], cols[order].astype(np.int32), n[order]
        totals = np.bincount(self.columns, n, len(languages)) + 0.5 * max(1, len(self.index))
        self.base = np.log(0.5 / totals) if languages else np.zeros(0)
        self.gains = np.log((n + 0.5) / 0.5)
        self.starts = np.searchsorted(rows, np.arange(len(self.index) + 1))

    def summed(self, rows: np.ndarray) -> np.ndarray:
        """The sum of the items' log frequencies, a number for each language."""
        first = self.starts[rows]
        sizes = self.starts[rows + 1] - first
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.columns[at], self.gains[at], len(self.base)) + len(rows) * self.base


class Model:
    def __init__(self, languages: list[str], words: tuple, grams: tuple):
        """words, grams: languages, items and counts, a list each."""
        self.languages = languages
        self.words, self.grams = Frequencies(languages, *words), Frequencies(languages, *grams)
        self.unseen: dict[str, np.ndarray] = {}
        self.most_unseen = CACHE_BYTES // (WORD_BYTES + 8 * len(languages))

    def backed_off(self, word: str) -> np.ndarray:
        """The mean over the word's characters of the longest known n-gram that ends there, edges marked."""
        s, rows = f"^{word}$", []
        get = self.grams.index.get
        for end in range(2, len(s) + 1):
            for n in range(min(LONGEST, end), 0, -1):
                if (row := get(s[end - n : end])) is not None:
                    rows.append(row)
                    break
        return self.grams.summed(np.array(rows, np.int64)) / len(rows) if rows else np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """(language, score, known words)."""
        words = words_of(text)
        if not self.languages or not words:
            return UNKNOWN, 0.0, 0
        rows = np.fromiter(map(self.words.index.get, words, repeat(-1)), np.int64, len(words))
        known = rows[rows >= 0]
        total = self.words.summed(known)
        unseen = self.unseen
        for k in np.flatnonzero(rows < 0).tolist():
            word = words[k]
            vector = unseen.get(word)
            if vector is None:
                if len(unseen) >= self.most_unseen:
                    unseen.clear()
                vector = unseen[word] = self.backed_off(word)
            total += vector
        sure = total / len(words) * min(len(words), EVIDENCE)
        odds = np.exp(sure - sure.max())
        best = int(np.argmax(sure))
        return self.languages[best], float(odds[best] / odds.sum()), len(known)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found: Counter = Counter()
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found.update(zip(repeat(lang), words_of(text)))  # noqa: B905
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())], ["lang", "item", "n"])


def fitted(docs: DataFrame) -> Model:
    """A model of the rows of docs whose text and lang are not null, or of a sample of them (SAMPLE_DOCS, SAMPLE_CHARS, ALL_CHARS).

    Rows without doc_id, or with one that repeats, are told apart by their text; rows alike in both are taken or left together."""
    ship(docs.sparkSession)
    pool = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = pool.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars")).collect()  # one row a language
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], ([], [], []), ([], [], []))
    most = min(SAMPLE_CHARS, ALL_CHARS / len(languages))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, SAMPLE_DOCS / r["docs"], most / max(1, r["chars"])))])
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = pool.filter(place < F.try_element_at(share, F.col("lang"))).select("lang", "text")
    words = sample.mapInArrow(_counter, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    marked = words.select("lang", "n", F.concat(F.lit("^"), F.col("item"), F.lit("$")).alias("marked"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size"))
    starts = F.when(F.length("marked") >= F.col("size"), F.sequence(F.lit(1), F.length("marked") - F.col("size") + 1)).otherwise(F.array().cast("array<int>"))
    grams = marked.select("lang", "n", "size", "marked", F.explode(starts).alias("at")).select("lang", "n", F.substring(F.col("marked"), F.col("at"), F.col("size")).alias("item"))
    grams = grams.groupBy("lang", "item").agg(F.sum("n").alias("n")).toArrow()
    model = Model(languages, *[tuple(t.column(c).to_pylist() for c in ("lang", "item", "n")) for t in (words.toArrow(), grams)])
    drop_stored(words)
    return model


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _predictor(model, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in _sliced(batches):
            found = [model.value.predict(t) for t in part.column(len(columns)).to_pylist()]
            made = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *made], [*columns, "lang_pred", "score", "n_known"])

    return run


def _filter(model, text: int, sure: float):
    """text: the place of the column with the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in _sliced(batches):
            found = [model.value.predict(t) for t in part.column(text).to_pylist()]
            yield part.filter(pa.array([f[0] != UNKNOWN and (f[1] >= sure or f[2] > 0) for f in found], pa.bool_()))

    return run


def predicted(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, unless given) with lang_pred, score and n_known (words that the model knows) for each whole text.

    Only the text is looked at. `und` with score 0 where the text is null or has no letter, or where nothing could be learnt. Repeated rows
    are predicted alike. Columns of docs named lang_pred, score or n_known are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    kept = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score", "n_known")]
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_known", T.LongType())]
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample
    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(_predictor(sent, kept), T.StructType([*docs.select(*kept).schema.fields, *made]))


def accepted(docs: DataFrame, model: Model, sure: float) -> DataFrame:
    """The rows of docs, all columns, in a language that the model knows: the score is `sure` at least, or one of the words is known (short
    texts that several languages share are not unsure of being language). Texts that are null or have no letter go."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample
    text = [c.lower() for c in docs.columns].index("text")  # sent once, as texts are most of a batch
    return docs.mapInArrow(_filter(sent, text, sure), docs.schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, by a model of those that aren't held out."""
    model = fitted(docs.filter(~held_out(F.col("doc_id"))))
    found = predicted(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
