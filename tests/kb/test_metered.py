"""Tables counted as they are written, and a build's counters and rejects held against separate counts."""

from __future__ import annotations

import os

import pytest
from kb_sources import write
from pyspark.sql import functions as F

from tarnflow.operators.metered import Meter
from tarnflow.plans.build import Sources, drift, run


def test_counts_are_those_of_the_table(spark):
    with Meter(spark) as meter:
        df = spark.range(1000).withColumn("even", F.when(F.col("id") > 9, F.col("id") % 2 == 0))
        got = meter.held(df.repartition(7), "numbers", evens=F.col("even"), total=F.col("id"))
        assert meter.counts == {"numbers": 1000, "evens": got.filter("even").count(), "total": 499500} and meter.times == 1
        assert got.dtypes == df.dtypes
        with pytest.raises(ValueError, match="numbers"):
            meter.held(df, "numbers")
        assert os.path.isdir(meter.folder.removeprefix("file://"))
    meter.release()
    assert not os.path.exists(meter.folder.removeprefix("file://"))


def test_a_table_without_rows_counts_nothing(spark):
    with Meter(spark) as meter:
        none = spark.createDataFrame([], "a int, b boolean")
        for k, df in enumerate((none, none.filter("false"), spark.range(9).filter("id > 10").selectExpr("cast(id as int) a", "true b"))):
            assert meter.held(df, f"t{k}", **{f"c{k}": F.col("b")}).count() == 0
        assert set(meter.counts.values()) == {0}


def test_counts_stand_above_the_last_exchange(spark):
    with Meter(spark) as meter:
        meter.held(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "groups", rows=F.col("count"))
        assert meter.counts == {"groups": 7, "rows": 100}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    made = run(spark, Sources(**write(tmp_path_factory.mktemp("sources"))))
    yield made
    made.meter.release()


def test_counters_are_those_of_the_tables(built):
    counters, tables = built.counters, built.tables
    for name, table in (("stigs", "stigs"), ("stig_rules", "stig_rules"), ("techniques", "techniques"), ("revocations", "revoked_technique"), ("mitigations", "mitigations"),
                        ("detection_strategies", "detection_strategies"), ("analytics", "analytics"), ("analytic_log_sources", "analytic_log_sources"), ("ccis", "ccis")):
        assert counters[name] == tables[table].count(), name
    assert counters["stig_files"] == counters["unreadable"] + sum(counters[f"kind_{k}"] for k in ("stig", "srg", "draft", "neither"))
    assert counters["same_key_departures"] == counters["superseded_by_library"] + counters["superseded_same_key"]


def test_rejects_tell_what_the_counters_count(built):
    c, rows = built.counters, built.rejects.collect()
    by = lambda thing, reason: sum(r.thing == thing and r.reason.startswith(reason) for r in rows)
    assert by("document", "unreadable") == c["unreadable"] == 3 and by("document", "draft") == c["skipped_draft"] == 1
    assert by("rule", "no severity") == c["unknown_severity"] == 1 and by("rule", "held by") == c["rule_id_collisions"] == 1
    assert by("pair", "no such technique") == c["orphan_ctid_pairs"] + c["orphan_override_pairs"] == 1
    assert by("mitigation", "no id") == c["mitigations_skipped"]
    assert all(r.source_document for r in rows if r.thing in ("document", "rule"))


def test_drift_of_rules(spark):
    stigs = spark.createDataFrame([("RHEL_1", "1"), ("RHEL_2", "1"), ("RHEL_1", "7"), ("Other", "1")], "stig_id string, version string")
    entries = [("rhel", "^RHEL", r"(?P<n>\d+)", [(2, "2"), (1, "1"), (0, None)]), ("none", "^Nothing", r"(?P<n>\d+)", [(0, "1")])]
    got = {tuple(r) for r in drift(stigs, entries).collect()}
    assert got == {("rhel", "7", "unmapped", 1), ("rhel", "2", "absent", 0), ("none", None, "idle", 0)}
    assert drift(stigs, []).count() == 0
