"""Reasons as codes and as sentences; listings of folders, files and releases."""

from __future__ import annotations

import json

import pytest

from tarnflow.operators import entities
from tarnflow.plans import notes
from tarnflow.sources import archives

META = "source_name string, source_version string, artifact string"
STIGS = "stig_id string, version string, release_label string, release_info string, origin string, xccdf_status string, xccdf_status_date string"


def stigs(spark, *rows):
    return spark.createDataFrame([(i, "1", "V1R1", "Release: 1", o, s, "2026-01-01") for i, o, s in rows], STIGS)


def codes(df, meta):
    return {r.stig_id: r.currency for r in notes.provenance(df, meta).collect()}


def test_provenance(spark):
    meta = spark.createDataFrame([("stig_library", "2026-04", "lib.zip"), ("attack", "1", None)], META)
    rows = stigs(spark, ("a", "library", "accepted"), ("b", "library", "deprecated"), ("c", "sunset", None), ("d", "loose", "accepted"), ("e", None, None))
    assert codes(rows, meta) == {"a": None, "b": "deprecated", "c": "sunset", "d": "local", "e": "local"}
    assert codes(rows.filter("origin <> 'library'"), meta) == {"c": "empty-library", "d": "empty-library"}
    assert codes(rows, meta.filter("source_name = 'attack'"))["c"] == "no-library" and codes(rows.limit(0), meta) == {}
    said = notes.currency_notes(rows, meta, [("b", "1"), ("a", "1"), ("c", "1"), ("zz", "9")])
    assert len(said) == 2 and "deprecated" in said[0] and "2026-01-01" in said[0] and "lib.zip" in said[1]
    assert notes.currency_notes(rows, meta, []) == []


def test_uncontrolled(spark):
    t = spark.createDataFrame([("T1", "2020-01-01", "mapped"), ("T2", "2020-01-01", "mapped"), ("T3", "2020-01-01", "non_mappable"), ("T4", "2025-01-01", "absent"), ("T5", "2020-01-01", "absent"), ("T6", None, "absent")], "technique_id string, created string, ctid_status string")
    pairs = spark.createDataFrame([("T1", False), ("T2", True)], "technique_id string, suppressed boolean")
    meta = spark.createDataFrame([("attack", "19.0", None), ("ctid_attack_version", "16.1", None), ("ctid_attack_release", "2024-10-31", None)], META)
    assert {r.technique_id: r.reason for r in notes.uncontrolled(t, pairs, meta).collect()} == {"T2": "suppressed", "T3": "reviewed", "T4": "newer", "T5": "uncovered", "T6": "undated"}
    bare = meta.filter("source_name <> 'ctid_attack_release'")
    assert {r.reason for r in notes.uncontrolled(t.filter("ctid_status = 'absent'"), pairs, bare).collect()} == {"undated"}
    said = notes.uncontrolled_notes(t, pairs, meta)
    assert len(said) == 5 and "2025-01-01" in said[2] and "16.1 (2024-10-31)" in said[2]
    assert "19.0" in notes.version_gap_note(meta) and notes.version_gap_note(bare.filter("source_name = 'attack'")) is None


def test_sentences():
    assert notes.named("abcdef") == "a, b, c, d and 2 more" and notes.named("ab") == "a, b"
    verdict = {"fragment": "RHEL 7", "fragment_confident": False, "verdict": "uncovered", "benchmarks": ["RHEL_8", "RHEL_9"], "covered_versions": ["8", "9"]}
    assert "RHEL_8, RHEL_9, for 8, 9" in notes.coverage_note(verdict) and notes.coverage_note(verdict | {"fragment_confident": True}) is None
    assert "benchmark_ids=['Chrome']" in notes.coverage_note(verdict | {"verdict": "version-agnostic", "benchmarks": ["Chrome"]})
    assert notes.tied_note(0, "x") is None and notes.tied_note(1, "x").startswith("1 more benchmark matches")
    assert notes.ruleless_note([], None) is None and "CAT I or CAT II rules" in notes.ruleless_note(["AC-2"], ["I", "II"])


def test_others_share_the_typed_name(spark):
    labels = spark.createDataFrame([("G1", "Red Otter", 1), ("G1", "Brook", 2), ("G2", "Red-Otter Group", 2), ("G2", "RedOtter", 2), ("G3", "Brook Team", 1)], "id string, label string, tier int")
    got = entities.others(labels, spark.createDataFrame([("red otter", "G1")], "typed string, id string")).collect()
    assert [(r.id, r.label) for r in got] == [("G2", "Red-Otter Group")]  # Brook Team shares another label of G1, not what was typed


def put(tmp_path, what):
    (tmp_path / "list.json").write_text(json.dumps(what))
    return str(tmp_path / "list.json")


def test_folder_and_file_listings(spark, tmp_path):
    dirs = [{"name": f"attack-{v}", "type": k} for v, k in (("9.1", "dir"), ("16.1", "dir"), ("17.0", "file"), ("18.1x", "dir"), ("../20.1", "dir"))]
    assert archives.latest_folder(spark, put(tmp_path, [*dirs, {"type": "dir"}])) == ("16.1", "attack-16.1")
    with pytest.raises(ValueError, match="no folder"):
        archives.latest_folder(spark, put(tmp_path, dirs[2:]))
    sha = "0123456789abcdef" * 2 + "01234567"
    assert archives.listed_blob(spark, put(tmp_path, [{"name": "c.json", "type": "dir"}, {"name": "c.json", "type": "file", "sha": sha}]), "c.json") == sha
    with pytest.raises(ValueError, match="no file"):
        archives.listed_blob(spark, put(tmp_path, [{"name": "c.json", "type": "dir"}]), "c.json")
    with pytest.raises(ValueError, match="no blob id"):
        archives.listed_blob(spark, put(tmp_path, [{"name": "c.json", "type": "file", "sha": "zz"}]), "c.json")


def test_assets_elsewhere_refuse_the_releases(spark, tmp_path):
    base = "https://example.org/r/releases/download/"

    def release(tag, *assets, **more):
        return {"tag_name": tag, "assets": [{"name": n, "browser_download_url": u or f"{base}{tag}/{n}"} for n, u in assets], **more}

    good = release("kb-1", ("kb-2026-01-02.json.zip", None), ("sums.txt", None), ("a/b", "https://elsewhere.org/"))
    draft = release("kb-2", ("kb-2026-01-03.zip", "https://elsewhere.org/x"), draft=True)
    assert [tuple(r) for r in archives.releases(spark, put(tmp_path, [good, draft, release("v1", ("kb-2026-01-02.zip", "https://x.org/y"))]), "kb-", base).collect()] == [("kb-1", "2026-01-02", "kb-2026-01-02.json.zip", f"{base}kb-1/kb-2026-01-02.json.zip")]
    for strange in (release("kb-3", ("sums.txt", "https://elsewhere.org/sums.txt")), release("kb-3", ("kb-2026-01-02.zip", None), ("x", f"{base}kb-4/x"))):
        with pytest.raises(Exception, match="a release lists"):
            archives.releases(spark, put(tmp_path, [good, strange]), "kb-", base).collect()


def test_release_dates_are_optional(spark, tmp_path):
    index = {"collections": [{"name": "Enterprise ATT&CK", "versions": [{"version": "16.1", "modified": "2024-10-31T00:00:00Z"}]}]}
    assert archives.release_dates(spark, put(tmp_path, index)) == {"16.1": "2024-10-31"}
    assert archives.release_dates(spark, None) == archives.release_dates(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "list.json").write_text("no json")
    assert archives.release_dates(spark, str(tmp_path / "list.json")) == {}
