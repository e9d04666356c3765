"""Document fingerprints: a quartile bucket digest of hashed byte triplets and the length, compared by a bounded difference."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import parts, ship

BUCKETS = 256
#: Distances within a window of five bytes of the three that are hashed together.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 1, 4))
#: Differences (of 3 steps in BUCKETS buckets at most, plus length) at and over which two digests count as unlike.
FAR = 220
PIECE = 1 << 20
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(data)), PIECE):
        raw = np.frombuffer(data[at : at + PIECE + 4], np.uint8).astype(np.uint32)
        n = min(PIECE, len(data) - at)
        for k, (a, b, c) in enumerate(TRIPLETS):
            m = min(n, len(raw) - c)
            if m > 0:
                # Multiply-shift over the 24 bits, another multiplier for each kind of triplet.
                packed = raw[a : a + m] | raw[b : b + m] << 8 | raw[c : c + m] << 16
                counts += np.bincount((packed + np.uint32(k << 24)) * np.uint32(0x9E3779B1) >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    """Hex: one byte of the length's logarithm, two of the quartiles' ratios, then two bits for each bucket: its quartile."""
    data = text.encode()
    counts = _counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    bits = code.reshape(-1, 4)
    body = (bits[:, 0] | bits[:, 1] << 2 | bits[:, 2] << 4 | bits[:, 3] << 6).astype(np.uint8)
    size = min(255, round(12 * log(1 + len(data))))
    ratios = [min(255, 255 * q // q3) if q3 else 0 for q in (q1, q2)]
    return bytes([size, *ratios]).hex() + body.tobytes().hex()


def likeness(one: str, other: str) -> float:
    """1 for equal digests down to 0 for those FAR or more apart. A step from the lowest to the highest quartile counts double."""
    if one == other:
        return 1.0
    a, b = np.frombuffer(bytes.fromhex(one), np.uint8), np.frombuffer(bytes.fromhex(other), np.uint8)
    shifts = np.array([0, 2, 4, 6], np.uint8)
    steps = np.abs((a[3:, None] >> shifts & 3).astype(int) - (b[3:, None] >> shifts & 3).astype(int))
    far = int(steps.sum()) + 3 * int((steps == 3).sum())
    size = abs(int(a[0]) - int(b[0]))
    far += max(0, size - 6) + (abs(int(a[1]) - int(b[1])) + abs(int(a[2]) - int(b[2]))) // 32
    return max(0.0, 1.0 - max(1, far) / FAR)


def edited(text: str, following: str) -> str:
    """text with its last third (whole code points) replaced by as many of the first of the following text, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, and in descending order within; those marked `other` follow the range but aren't of it."""
    last = None  # (range, doc_id, text, digest)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            rows = []
            for place, other, doc_id, text in zip(*[c.to_pylist() for c in batch.slice(at, 500).columns], strict=True):
                own = digest(text)
                if last is not None and last[0] == place:
                    changed = edited(last[2], text)
                    mark = digest(changed)
                    rows.append((last[1], len(last[2]), hashlib.sha256(changed.encode()).hexdigest(), last[3], mark, likeness(last[3], mark), likeness(last[3], own)))
                last = None if other else (place, doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The fingerprint of every whole text and of its edited text, and how near they and the next document's are.

    The order is descending doc_id, null doc_ids last, rows of one doc_id by their text; the first follows the last. A null text counts as an
    empty one. A table of one row follows itself; an empty one gives no row. Columns but doc_id and text aren't looked at. Texts are
    shuffled once, into ranges of doc_id; the first rows of each range also go to the end of the range before.
    """
    spark = docs.sparkSession
    ship(spark)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select("doc_id", key.alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    n = parts(spark) * 2
    bounds = rows.agg(F.percentile_approx("_key", [k / n for k in range(1, n)], 10_000).alias("b")).first().b or []  # n numbers
    cuts = np.array(sorted(set(bounds)), np.int64)
    # Range 0 holds the greatest keys.
    heads_of = F.pandas_udf(lambda s: pd.Series(len(cuts) - np.searchsorted(cuts, s.to_numpy(np.int64), "right")), "int")
    heads = rows.select("_key").withColumn("_range", heads_of("_key")).groupBy("_range").agg(F.max("_key").alias("top")).orderBy("_range").collect()  # a row for each range
    tops = {r.top: heads[k - 1]._range for k, r in enumerate(heads)}  # the first range's top follows the last range

    @F.pandas_udf("array<int>")
    def ranges(keys: pd.Series) -> pd.Series:
        own = (len(cuts) - np.searchsorted(cuts, keys.to_numpy(np.int64), "right")).tolist()
        return pd.Series([[r, tops[k]] if k in tops else [r] for k, r in zip(keys.tolist(), own, strict=True)])

    dealt = rows.withColumn("_ranges", ranges("_key")).select("doc_id", "_key", "text", F.posexplode("_ranges").alias("_other", "_range"))
    ordered = dealt.repartition(n, "_range").sortWithinPartitions("_range", "_other", F.desc("_key"), "text")
    return ordered.select("_range", "_other", "doc_id", "text").mapInArrow(_follow, SCHEMA)


