"""Collisions, splits and contests: the plan against the replay, and the replay against cases told by hand."""

from __future__ import annotations

import random

import pytest

from tarnflow.operators import arbitration

SCHEMA = "stig_id string, version string, arrival string, artifact string, release int, is_library boolean, status_date string, path string, rules array<string>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def doc(stig_id, arrival, rules, artifact="a.zip", release=1, is_library=False, date="2024-01-01", path=None, version="1"):
    return (stig_id, version, arrival, artifact, release, is_library, date, path or f"x/{arrival}.xml", rules)


def fates(spark, rows, corrections=None):
    plan, replay = arbitration.settled(frame(spark, rows), corrections), arbitration.replayed(frame(spark, rows), corrections)
    assert arbitration.disagreements(plan, replay).collect() == []
    return plan, {r.arrival: (r.final_id, r.fate) for r in replay.collect()}


SPLIT = {"S": [("db", "S_DB"), ("inst", "S_INST")]}


def test_a_pair_is_split_and_others_follow(spark):
    rows = [doc("S", "1", ["r1"], path="p/db.xml"), doc("S", "2", ["r9"], artifact="b.zip", path="p/other.xml"), doc("S", "3", ["r2"], path="p/inst.xml"), doc("S", "4", ["r3"], artifact="c.zip", release=2, path="p/inst2.xml")]
    plan, told = fates(spark, rows, SPLIT)
    assert told == {"1": ("S_DB", "kept"), "2": (None, "superseded_same_key"), "3": ("S_INST", "superseded_same_key"), "4": ("S_INST", "kept")}
    assert plan.counters() == {"same_key_content_collision": 1, "same_key_collision_unmapped": 1, "superseded_by_library": 0, "superseded_same_key": 2, "same_key_departures": 2, "id_corrections_applied": 2}


@pytest.mark.parametrize("change", [dict(artifact="b.zip"), dict(release=2), dict(rules=[]), dict(rules=["r1", "r2"])])
def test_what_is_no_collision(spark, change):
    rows = [doc("S", "1", ["r1"], path="p/db.xml"), doc("S", "2", **({"rules": ["r2"], "path": "p/inst.xml"} | change))]
    plan, told = fates(spark, rows, SPLIT)
    assert {f for f, _ in told.values()} == {"S"} and plan.counters()["same_key_content_collision"] == 0


def test_collisions_that_cannot_be_split(spark):
    unmapped = [doc("T", "1", ["r1"]), doc("T", "2", ["r2"])]
    plan, told = fates(spark, unmapped, SPLIT)
    assert {f for f, _ in told.values()} == {"T"} and plan.counters()["same_key_collision_unmapped"] == 1
    half = [doc("S", "1", ["r1"], path="p/db.xml"), doc("S", "2", ["r2"], path="p/none.xml")]
    plan, told = fates(spark, half, SPLIT)
    assert {f for f, _ in told.values()} == {"S"} and plan.counters()["same_key_collision_unmapped"] == 1
    taken = [doc("S_DB", "0", ["q"]), doc("S", "1", ["r1"], path="p/db.xml"), doc("S", "2", ["r2"], path="p/inst.xml")]
    plan, told = fates(spark, taken, SPLIT)
    assert told["1"][0] == told["2"][0] == "S" and plan.counters()["same_key_collision_unmapped"] == 1
    later = [doc("S", "1", ["r1"], path="p/db.xml"), doc("S", "2", ["r2"], path="p/inst.xml"), doc("S_DB", "3", ["q"], release=2)]
    plan, told = fates(spark, later, SPLIT)
    assert told == {"1": ("S_DB", "superseded_same_key"), "2": ("S_INST", "kept"), "3": ("S_DB", "kept")}
    assert plan.counters()["id_corrections_applied"] == 1


def test_other_versions_do_not_occupy(spark):
    rows = [doc("S_DB", "0", ["q"], version="2"), doc("S", "1", ["r1"], path="p/db.xml"), doc("S", "2", ["r2"], path="p/inst.xml")]
    assert fates(spark, rows, SPLIT)[1]["1"] == ("S_DB", "kept")


def test_plan_and_replay_agree_on_anything(spark):
    """Ids that corrections chain, ties in every column of the contest, null dates, documents without rules."""
    pick = random.Random(11)
    corrections = {"A": [("x", "B"), ("y", "C")], "C": [("x", "D"), ("z", "A")], "F": [("x", "G"), ("y", "H")]}
    rows = []
    for i in range(1500):
        rules = pick.choice([[], None, *[[f"r{pick.randint(1, 4)}" for _ in range(pick.randint(1, 2))] for _ in range(6)]])
        rows.append((pick.choice("ABCDEFGHI"), str(pick.randint(1, 40)), f"{i:05}", pick.choice(["p.zip", "q.zip"]), pick.randint(1, 2), pick.random() < 0.3, pick.choice([None, "2024-01-01", "2025-01-01"]), pick.choice(["x", "y", "z", "xy", None]), rules))
    pick.shuffle(rows)
    plan, told = fates(spark, rows, corrections)
    counted = plan.counters()
    assert counted["same_key_departures"] == sum(fate != "kept" for _, fate in told.values()) and counted["superseded_by_library"] == sum(fate == "superseded_by_library" for _, fate in told.values())
    verdicts = {r.verdict for r in plan.documents.select("verdict").distinct().collect()}
    assert verdicts == {"single", "split", "occupied", "unmapped"}


def test_disagreements_are_found(spark):
    rows = [doc("S", "1", ["r1"]), doc("S", "2", ["r1"], release=2)]
    other = [doc("S", "1", ["r1"], release=3), doc("S", "2", ["r1"], release=2)]
    found = arbitration.disagreements(arbitration.settled(frame(spark, rows)), arbitration.replayed(frame(spark, other))).collect()
    assert [(r.what, r.planned, r.replayed) for r in found] == [("winner", "2", "1")]


def test_a_bucket_whose_documents_share_a_rule_is_linear(spark):
    rows = [doc("S", f"{i:05}", ["common", f"r{i}"]) for i in range(4000)]
    assert arbitration.collisions(frame(spark, rows)).count() == 0


@pytest.mark.parametrize("wrong", [{"S": [("db", "A")]}, {"S": [("db", "A"), ("db", "B")]}, {"S": [("db", "A"), ("in", "A")]}, {"S": [("", "A"), ("in", "B")]}, {"S": [("db", None), ("in", "B")]}])
def test_corrections_are_checked(wrong):
    with pytest.raises(ValueError, match="correction of S"):
        arbitration.checked(wrong)
