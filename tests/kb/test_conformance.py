"""Findings of a corpus, and their report."""

from __future__ import annotations

import json

import pytest
from kb_sources import benchmark, write

from tarnflow.plans import conformance
from tarnflow.plans.build import Sources, run
from tarnflow.sources import documents


def stigs(spark, *titles):
    return spark.createDataFrame([(f"S{k}", "1", title, "") for k, title in enumerate(titles)], "stig_id string, version string, title string, product_keywords string")


def test_padded_versions(spark):
    rows = stigs(spark, "Linux 22.04", "Gadget 08", "Gadget v08 and v009", "Gadget 08 on Photon 4.08", "Gadget 8", "")
    got = {r.stig_id: r.padded for r in conformance.padded_versions(rows.unionByName(rows)).collect()}
    assert got == {"S1": ["08"], "S2": ["009", "08"], "S3": ["08"]}
    assert conformance.padded_versions(rows).count() == 3  # a benchmark's two majors are one finding


def test_parse_findings(spark):
    texts = [benchmark("A", "T", "1", 2), benchmark("B", "T", "one", 2), benchmark("C", "T").replace("Release: 1 Benchmark Date: 2025-01-01", " "), "<Benchmark>", "<other/>"]
    files = spark.createDataFrame([(str(k), text) for k, text in enumerate(texts)], "source_document string, content string")
    got = sorted((r.severity, r.name) for r in conformance.parse_findings(documents.benchmarks(files)).collect())
    assert got == [("error", "3"), ("error", "4"), ("error", "C"), ("warning", "B"), ("warning", "C")]
    assert conformance.parse_findings(documents.benchmarks(files.limit(0))).count() == 0


def test_resolver_findings_name_what_splits_and_what_is_near_the_gate(spark):
    rows = stigs(spark, "Display and Search Tool", *[f"Gadget {k}x" for k in range(9)])
    got = {(r.severity, r.name) for r in conformance.resolver_findings(rows).collect()}
    assert ("info", "display/search") in got and ("info", "tool") in got and not any(n == "gadget" for _, n in got)  # 9 of 10 is far from the gate


def test_report_of_a_build(spark, tmp_path):
    sources = tmp_path / "sources"
    sources.mkdir()
    built = run(spark, Sources(**write(sources)))
    try:
        path = str(tmp_path / "report")
        counts = conformance.write_report(conformance.findings_of(built), {"first": built.counters}, path)
        rows = [json.loads(line) for part in sorted((tmp_path / "report" / "findings").glob("part-*")) for line in part.read_text().splitlines()]
        assert counts["error"] == sum(r["severity"] == "error" for r in rows) >= 3 and all(r["severity"] == "error" for r in rows[: counts["error"]])
        text = (tmp_path / "report" / "report.md").read_text()
        assert f"{counts['error']} error, {counts['warning']} warning, {counts['info']} info" in text and "| stigs | 2 |" in text
        with pytest.raises(Exception):
            conformance.write_report(conformance.findings_of(built), {}, path)
    finally:
        built.meter.release()
