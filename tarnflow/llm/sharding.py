"""Sharding: a Feistel permutation with cycle walking over global row numbers gives a reproducible shuffle and computable shards and slots."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import stored
from tarnflow.llm.order import ranked

ROUNDS = 6
#: Steps of the walk; one leaves the range with a chance under 1 in sqrt(rows), and in small tables the steps cover every way out.
WALK = 64


def sides(rows: int) -> tuple[int, int]:
    """Two sides whose product is the least rectangle for rows: a * b >= rows > a * (b - 1)."""
    a = max(1, isqrt(rows - 1) + 1 if rows > 1 else 1)
    return a, max(1, -(-rows // a))


def permuted(row: Column, rows: int, seed: int) -> Column:
    """Where row goes in a permutation of 0..rows-1.

    Balanced Feistel rounds on (row div b, row mod b), with addition modulo the side in place of xor, permute the rectangle a * b; a value
    outside the range walks on along its cycle, which must come back into it.
    """
    a, b = sides(rows)

    def once(x: Column) -> Column:
        right = F.pmod(x, F.lit(b))
        left = ((x - right) / F.lit(b)).cast("long")  # exact: the division leaves no rest
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed * 1000 + k)), F.lit(a)), F.lit(a))
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed * 1000 + k)), F.lit(b)), F.lit(b))
        return left * F.lit(b) + right

    steps = max(1, min(WALK, a * b - rows))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once(row), lambda x, _: F.when(x < rows, x).otherwise(once(x)))
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def shuffled(docs: DataFrame, shards: int, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot.

    The law is `rows`: shard counts differ by one at most, and slots are gapless from 0. Both can be computed from the row's global number
    in the order (key, size, text_crc32), nulls first; rows that agree in all three are alike and may change places. A null text counts as
    an empty one. An empty table gives an empty result. Other columns of docs are not looked at.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "size", "text_crc32")]
    numbered = stored(ranked(narrow, order), "numbered")
    rows = numbered.count()
    if not rows:
        return numbered.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    at = permuted(F.col("_row"), rows, seed)
    dealt = numbered.select("doc_id", "size", "text_crc32", at.alias("_at"))
    return dealt.select("doc_id", "size", "text_crc32", F.pmod("_at", F.lit(shards)).cast("int").alias("shard"), F.expr(f"_at div {int(shards)}").alias("slot"))
