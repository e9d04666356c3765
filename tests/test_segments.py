"""Scans over ranges against the same scan told row by row; one key holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import rank, relational, segments

SCHEMA = "k string, at int, n int, v int"


def made(seed=5, rows=600):
    draw = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(draw.choice(keys), draw.randrange(40), i, draw.choice([None, draw.randrange(100)])) for i in range(rows)]


def told(rows, kind, inclusive):
    states, out = {}, {}
    for k, _, n, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        before = states.get(k)
        after = before if v is None else v if before is None or kind == "last" else max(before, v) if kind == "max" else before + v
        states[k] = after
        out[n] = after if inclusive else before
    return out


@pytest.mark.parametrize("kind", ["max", "sum", "last"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_states(spark, kind, inclusive):
    rows = made()
    got = segments.running(spark.createDataFrame(rows, SCHEMA), ["k"], [F.asc("at"), F.asc("n")], F.col("v"), "state", kind, inclusive, parts=7)
    assert got.columns == ["k", "at", "n", "v", "state"]
    assert {r.n: r.state for r in got.collect()} == told(rows, kind, inclusive)


def test_a_key_is_split_over_ranges(spark):
    rows = spark.createDataFrame([("hot", i, i, 1) for i in range(2000)], SCHEMA)
    sizes = [r["count"] for r in segments.ranged(rows, ["k"], [F.asc("at")], 8).groupBy("_segment").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 500


def test_firsts_with_descending_order_and_nulls(spark):
    rows = made(seed=9)
    got = segments.firsts(spark.createDataFrame(rows, SCHEMA), ["k"], [F.desc_nulls_last("v"), F.asc("n")], ["n", "v"], parts=5).collect()
    best = {}
    for r in sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[2])):
        best.setdefault(r[0], r)
    assert len(got) == len(rows)
    assert {(r.k, r.holder_n, r.holder_v) for r in got} == {(k, r[2], r[3]) for k, r in best.items()}
    assert sorted(r.n for r in got if r.held) == sorted(r[2] for r in best.values())


def test_empty_table_and_one_row(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert segments.running(none, ["k"], [F.asc("at")], F.col("v"), "s").collect() == []
    assert segments.firsts(none, ["k"], [F.asc("at")], ["n"]).collect() == []
    one = spark.createDataFrame([(None, 1, 1, None)], SCHEMA)
    assert [r.s for r in segments.running(one, ["k"], [F.asc("at")], F.col("v"), "s").collect()] == [None]


def test_as_of_takes_null_values_and_equal_times(spark):
    asked = spark.createDataFrame([("x", 5, 1), ("x", 4, 2), ("y", 5, 3), ("x", 9, 4)], "k string, at int, id int")
    steps = spark.createDataFrame([("x", 5, "five"), ("x", 8, None), ("z", 1, "z")], "k string, since int, name string")
    got = relational.range_lookup(asked, "k", "at", steps, "since", "name")
    assert {r.id: r.name for r in got.collect()} == {1: "five", 2: None, 3: None, 4: None}  # the row since 8 says null, which is its answer


def test_departures_follow_arrival(spark):
    rows = made(seed=3, rows=300)
    docs = spark.createDataFrame([(k, n, v or 0, n % 3 == 0) for k, _, n, v in rows], "k string, n int, v int, lib boolean")
    want = {}
    lead = {}
    for k, _, n, v in rows:
        own = (v or 0, -n, n % 3 == 0)
        if k in lead:
            winner, loser = max(own, lead[k]), min(own, lead[k])
            at = 0 if winner[2] and not loser[2] else 1
            want.setdefault(k, [0, 0])[at] += 1
        lead[k] = max(own, lead.get(k, own))
    got = rank.departures(docs, ["k"], F.col("v"), "lib", "n").collect()
    assert {r.k: [r.superseded_by_library, r.superseded_same_key] for r in got} == want
