"""What large tables and odd rows met: which side is sent, what is kept in one task, what is written."""

from __future__ import annotations

import random

import pyarrow as pa
from oracle import connect, rows
from pyspark.sql import functions as F

from tarnflow.operators import arbitration, relational, segments
from tarnflow.plans import registry


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_aliases_are_sent_to_the_rows(spark, tmp_path):
    """The rows' size is guessed from their file, before their tokens are unfolded: it must not decide which side is sent."""
    spark.range(1000).select(F.col("id").alias("k"), F.array(F.lit("a"), F.col("id").cast("string")).alias("toks")).write.parquet(f"{tmp_path}/rows")
    hits = relational.alias_hits(spark.read.parquet(f"{tmp_path}/rows"), "k", "toks", [("one", 0, ["a", "17"]), ("one", 1, ["17"]), ("two", 0, ["b"])])
    assert "BuildRight" in plan(hits) and "BuildLeft" not in plan(hits)
    assert [tuple(r) for r in hits.collect()] == [(17, "one", 0)]


def test_a_part_without_a_name_has_no_aliases(spark, tmp_path):
    parts = [(1, "old steel", "Brand#13", "PROMO"), (2, None, "Brand#13", "STEEL"), (3, "steel", None, "X"), (4, "bolt", "Brand#1", "STEEL")]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"create or replace view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    df = registry.queries()["alias_subset"](spark, str(tmp_path))
    want = con.execute(registry.oracle_sql()["alias_subset"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in want.description], want.fetchall()) != []


CLAIM = "stig_id string, version string, arrival long, artifact string, release int, is_library boolean, status_date string, path string, rules array<string>"


def claims(spark, rows):
    return spark.createDataFrame([(i, "1", k, "a", 1, k % 3 == 0, "2024-01-01", ("x", "y")[k % 2], r) for i, k, r in rows], CLAIM)


def test_pairs_of_large_buckets_are_the_first_ones(spark):
    """Buckets of many documents that nearly all share rules, against all pairs."""
    pick, rows, want = random.Random(3), [], {}
    for n, (letters, size, many) in enumerate([("abcdefgh", 4, 60), ("abcdefgh", 4, 400), ("abcdefghi", 5, 500), ("abcdefghij", 4, 80), ("ab", 1, 3)]):
        own = [(f"S{n}", n * 1000 + k, pick.sample(letters, size) * 2) for k in range(many)]
        rows += own
        if found := next(((a[1], b[1]) for i, a in enumerate(own) for b in own[i + 1 :] if set(a[2]).isdisjoint(b[2])), None):
            want[f"S{n}"] = found
    pick.shuffle(rows)
    assert {r.stig_id: (r.first, r.second) for r in arbitration.collisions(claims(spark, rows)).collect()} == want
    assert len(want) == 4


def test_a_bucket_is_no_call_of_its_own(spark):
    found = arbitration.collisions(claims(spark, [("S", 1, ["a"]), ("S", 2, ["b"])]))
    assert "FlatMapGroups" not in plan(found) and "MapInArrow" in plan(found)


def test_contests_are_scanned_when_departures_are_asked_for(spark, monkeypatch):
    def unasked(*_, **__):
        raise AssertionError("documents and winners need no scan")

    docs = claims(spark, [("S", k, [f"r{k % 2}"]) for k in range(6)])
    with monkeypatch.context() as m:
        m.setattr(segments, "running", unasked)
        found = arbitration.settled(docs)
        assert found.documents.count() == 6 and [r.arrival for r in found.winners.collect()] == [0]
    assert [tuple(r) for r in found.departures.collect()] == [("S", "1", 4, 1)]  # 3 is the library too


def test_a_family_is_replayed_in_a_stream(spark):
    """The automaton lets go of documents while others still come, and no group of rows is one table."""
    rows = [("S", k, ["common", f"r{k}"]) for k in range(20)] + [("T", 100 + k, [f"r{k}"]) for k in range(20)]
    replay = arbitration.replayed(claims(spark, rows), {"T": [("x", "T_X"), ("y", "T_Y")]})
    assert "FlatMapGroups" not in plan(replay)
    told = {r.arrival: (r.final_id, r.fate) for r in replay.collect()}
    assert told[0] == ("S", "kept") and told[1] == ("S", "superseded_by_library") and told[3] == ("S", "superseded_same_key")
    assert {f for f, _ in told.values()} == {"S", "T_X", "T_Y"} and len(told) == 40 and sum(fate == "kept" for _, fate in told.values()) == 3
    taken, head = [], pa.struct([(f"{x}_{c}", t) for x in "ab" for c, t in (("arrival", pa.int64()), ("is_library", pa.bool_()), ("status_date", pa.string()), ("path", pa.string()))] + [("artifact", pa.string()), ("release", pa.int32())])
    kinds = pa.schema([("family", pa.string()), ("stig_id", pa.string()), ("version", pa.string()), ("arrival", pa.int64()), ("artifact", pa.string()), ("release", pa.int32()), ("is_library", pa.bool_()), ("status_date", pa.string()), ("path", pa.string()), ("head", head)])
    none = {f.name: None for f in head}

    def coming():
        for n in range(50):
            taken.append(n)
            docs = [("S", "S", "1", n * 10 + k, "a", 1, False, "2024-01-01", "x", None) for k in range(10)]
            events = [("S", "S", "1", None, None, None, None, None, None, none)] * (n == 0) + docs
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, e)) for e in events], kinds)

    out = arbitration._automaton({})(coming())
    assert next(out).num_rows == 9 and len(taken) == 1
    assert sum(b.num_rows for b in out) == 491


def test_claims_without_an_id_or_version_collide_in_neither(spark):
    rows = [(i, v, k, "a", 1, False, "2024-01-01", "x", [f"r{k}"]) for k, (i, v) in enumerate([(None, "1"), (None, "1"), ("S", None), ("S", None)])]
    docs = spark.createDataFrame(rows, CLAIM)
    found, split = arbitration.settled(docs, {"S": [("x", "A"), ("y", "B")]}), {"S": [("x", "A"), ("y", "B")]}
    assert {r.verdict for r in found.documents.collect()} == {"single"} and found.documents.count() == 4
    assert {(r.arrival, r.final_id) for r in arbitration.replayed(docs, split).collect()} == {(0, None), (1, None), (2, "S"), (3, "S")}
