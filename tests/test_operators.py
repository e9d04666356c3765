"""Traps: ties, arrival order, wildcards, tri-state flags, published listings, and the stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tarnflow.functions import ids, text
from tarnflow.operators import changes, entities, graph, rank, relational
from tarnflow.sources import archives, documents
from tarnflow.streaming import refresh


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_ids(spark):
    lit = F.lit
    assert tuple(one(spark, ids.control_id(lit("see ac-02 (003) x")), ids.control_id(lit("nothing")), ids.catalog_control_id(lit("ac-2.10")), ids.catalog_control_id(lit("ac-2 x")))) == ("AC-2(3)", None, "AC-2(10)", None)
    assert one(spark, ids.sorted_versions(F.array(lit("10.0"), lit("8"), lit("v1"), lit("09"), lit("9")))).c0 == ["8", "09", "9", "10.0", "v1"]
    assert tuple(one(spark, ids.document_kind(lit(None), lit("xccdf_mil.disa.stig_benchmark_A"), lit("x")), ids.document_kind(lit("Draft"), lit("A_STIG"), lit("x")), ids.document_kind(lit(""), lit("A_SRG"), lit("x")), ids.document_kind(lit(""), lit("zOS_for_RACF_STIG"), lit("")))) == ("neither", "draft", "srg", "stig")
    assert one(spark, ids.git_blob_sha(F.encode(lit("hello\n"), "UTF-8"))).c0 == "ce013625030ba8dba906f756967f9e9ca394464a"
    with pytest.raises(Exception, match="out of scope"):
        one(spark, ids.archive_tier(lit("CUI_x.zip")))


def test_text(spark):
    t = one(spark, text.normalized(F.lit("RHEL 9 Layer 2 switch security guide v1r2"))).c0
    assert t.version == ["9", "v1r2"] and "2" in t.product and "guide" not in t.product and t.expanded == ["enterprise", "hat", "linux", "red"]
    assert one(spark, text.version_runs(F.lit("IIS 10-0 on F5, Layer 2, tier  1 and v8.1"))).c0 == ["10.0", "8.1"]
    rows = spark.createDataFrame([("a_c",), ("abc",), ("A\\C",), ("x%y",)], "s string")
    assert {r.s for r in rows.filter(text.like(F.col("s"), "A_C")).collect()} == {"a_c", "abc", "A\\C"}


def test_contest_does_not_depend_on_how_rows_lie(spark):
    rows = [("k", "1", 1, 2, True, None, "a", 3), ("k", "1", 1, 2, True, "", "a", 1), ("k", "1", 1, 2, False, "2025", "z", 0), ("k", "1", 1, 1, True, "2026", "z", 2)]
    df = spark.createDataFrame(rows, "id string, version string, major int, release int, lib boolean, date string, artifact string, arrival int")
    for n in (1, 3):
        won = rank.contest(df.repartition(n), ["id", "version"], major="major", release="release", is_library="lib", status_date="date", artifact="artifact", arrival="arrival").collect()
        assert [r.arrival for r in won] == [1]


def test_division_is_not_vacuous_and_tri_state(spark):
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    items = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "k string, i string")
    assert {r.k: r.holds for r in relational.divided(parents, "k", items, "i", ["x"]).collect()} == {"a": False, "b": True, "c": False}
    assert {r.holds for r in relational.divided(parents, "k", items, "i", None).collect()} == {None}


def test_closure_of_long_chains_and_cycles(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1005, 1001)]
    got = {r.a: (r.b, r.outcome) for r in graph.closure(spark.createDataFrame(edges, "a long, b long"), "a", "b", spark.createDataFrame([(300,)], "k long")).collect()}
    assert all(got[k] == (300, "resolved") for k in range(300)) and all(got[k] == (None, "cycle") for k in (1000, 1001, 1002, 1005))


def test_lifecycle(spark):
    rows = [("A", 1, True), ("a", 1, False), ("a", 2, False), ("b", 1, False), ("b", 3, False), ("C", 2, True), ("c", 1, False)]
    got = {(r.k, r.m, r.lib) for r in rank.lifecycle(spark.createDataFrame(rows, "k string, m int, lib boolean"), "k", major="m", is_library="lib").collect()}
    assert got == {("A", 1, True), ("a", 1, False), ("a", 2, False), ("b", 3, False), ("C", 2, True)}


def test_asof_lookup(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 1), (None, 3)], "k string, at int")
    right = spark.createDataFrame([("a", 5, "five"), ("a", 7, None), ("b", 2, "two")], "k string, least int, v string")
    assert {(r.k, r.at): r.v for r in relational.range_lookup(left, "k", "at", right, "least", "v").collect()} == {("a", 1): None, ("a", 5): "five", ("a", 9): None, ("b", 1): None, (None, 3): None}


def test_entities(spark):
    labels = spark.createDataFrame([(1, "Red Otter", 1), (2, "Red Ottar", 1), (3, "Pond", 2), (4, "pond", 2)], "id int, label string, tier int")
    typed = spark.createDataFrame([("red  otter TEAM",), ("POND",), ("Rad Otter",), ("ＲＥＤ Ottar",)], "typed string")
    got = {(r.typed, r.id): r.tier for r in entities.matched(labels, typed).collect()}
    assert got == {("red  otter TEAM", 1): 3, ("POND", 3): 2, ("POND", 4): 2, ("ＲＥＤ Ottar", 2): 1}
    near = entities.suggested(labels, typed.filter("typed = 'Rad Otter'")).orderBy("place").collect()
    assert [r.id for r in near] == [1, 2]


def test_merge_and_prune(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "name string, size int, sha string")
    new = spark.createDataFrame([("b", 3, "n"), ("c", 4, "m")], "name string, size int, sha string")
    assert {tuple(r) for r in changes.merged(base, new, "name", "size", "sha").collect()} == {("a", 1, "x"), ("b", 3, None), ("c", 4, "m")}
    assert changes.drop_share(base, base.limit(1), "name", 0.25).first().refused


def test_published_listing(spark, tmp_path):
    base = "https://dl.test/zip/"
    rows = [("https://dl.test//zip/U_A_V1R2_STIG.zip", "2025"), ("https://mirror.test/zip/U_A_V1R10_STIG.zip", "2025"), ("https://dl.test/zip/U_A_V1R2_STIG.zip", "2026"), ("https://else.test/x/U_B.zip", "2026"), ("https://dl.test/zip/readme.pdf", "")]
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"returnValue": [{"DownloadLink": a, "UploadDate": b} for a, b in rows]}))
    found, off = archives.published_zips(spark, str(path), base, "/zip/")
    assert {tuple(r) for r in found.collect()} == {("U_A_V1R2_STIG.zip", "2026"), ("U_A_V1R10_STIG.zip", "2025")} and [r.link for r in off.collect()] == ["https://else.test/x/U_B.zip"]
    assert [r.name for r in archives.newest_per_product(found).collect()] == ["U_A_V1R10_STIG.zip"]
    path.write_text(json.dumps({"returnValue": [{"DownloadLink": base + "%2e%2e%2fescape.zip"}]}))
    with pytest.raises(Exception, match="not a plain file name"):
        archives.published_zips(spark, str(path), base, "/zip/")[0].collect()


def test_libraries_releases_sums(spark, tmp_path):
    names = spark.createDataFrame([("U_SRG-STIG_Library_April_2026.zip",), ("U_SRG-STIG_Library_2026_07.zip",), ("U_SRG-STIG_Library_January_2025.zip",), ("U_Sunset_Compilation_2030_01.zip",)], "name string")
    assert archives.newest_library(names) == "U_SRG-STIG_Library_2026_07.zip"
    with pytest.raises(ValueError):
        archives.newest_library(names.limit(0))
    sums = tmp_path / "s.txt"
    sums.write_text("a" * 64 + "  kb.xz\n")
    assert archives.checksums(spark, str(sums)).first()["name"] == "kb.xz"
    sums.write_text("nonsense\n")
    with pytest.raises(Exception, match="not a checksum line"):
        archives.checksums(spark, str(sums)).collect()
    rel = tmp_path / "r.json"
    rel.write_text(json.dumps([{"tag_name": "kb-7", "draft": False, "prerelease": False, "assets": [{"name": "kb-2026-07-01.sqlite.xz", "browser_download_url": "u"}]}, {"tag_name": "kb-7b", "draft": True, "assets": []}]))
    assert [(r.tag_name, r.date) for r in archives.releases(spark, str(rel), "kb-").collect()] == [("kb-7", "2026-07-01")]
    index = tmp_path / "i.json"
    index.write_text(json.dumps({"collections": [{"name": "Enterprise ATT&CK", "versions": [{"version": "9.1", "modified": "2021-01-01T00"}, {"version": "19.2", "modified": "2026-01-01T00"}]}]}))
    assert archives.latest_attack(spark, str(index)) == ("19.2", {"9.1": "2021-01-01", "19.2": "2026-01-01"})


def test_extract_numbers_other_contents(spark):
    docs = spark.createDataFrame([("p/a.xml", "1"), ("q/a.xml", "2"), ("r/a.xml", "1"), ("b.xml", "3")], "source_document string, content string")
    assert {(r.name, r.content) for r in archives.extracted(docs).collect()} == {("a.xml", "1"), ("2_a.xml", "2"), ("b.xml", "3")}


def test_overrides(spark, tmp_path):
    path = tmp_path / "o.yaml"
    path.write_text("# note\nadd:\n  - {technique: T1, control: AC-2}\n  - technique: T2\n    control: 'AC-3'\nsuppress: []\n")
    added, gone = documents.overrides(spark, str(path))
    assert {tuple(r) for r in added.collect()} == {("T1", "AC-2"), ("T2", "AC-3")} and gone.isEmpty()
    with pytest.raises(FileNotFoundError):
        documents.overrides(spark, str(tmp_path / "none"), named=True)


def test_refresh_stream_rebuilds_only_for_new_content(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.xml").write_text("one")
    run = lambda: refresh.refreshed(spark, str(folder), str(tmp_path / "m"), str(tmp_path / "c"), lambda rows: seen.append(sorted(r.name for r in rows.collect()))).awaitTermination()
    run()
    (folder / "b.xml").write_text("two")
    run()
    run()
    assert seen == [["a.xml"], ["b.xml"]]


def test_event_windows_on_a_stream(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "e"))
    stream = refresh.event_counts(spark.readStream.schema(source.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").selectExpr("start", "event_type", "n").collect())) == sorted(map(tuple, refresh.event_counts(source).selectExpr("start", "event_type", "n").collect()))


def test_actions_and_lengths(spark):
    rows = spark.createDataFrame([("a", "1", "1", None), ("b", "1", "2", None), ("c", None, "2", None), ("d", "1", None, "no answer")], "source string, recorded string, published string, problem string")
    assert {r.source: r.action for r in changes.actions(rows).collect()} == {"a": "none", "b": "refresh", "c": "ingest", "d": "skip"}
    have = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "name string, length int")
    was = spark.createDataFrame([("x", 1), ("y", 9), ("z", None)], "name string, length int")
    assert [r.name for r in changes.unchanged(have, was, "name", "length").collect()] == ["x"]


def test_others_share_a_loose_label(spark):
    labels = spark.createDataFrame([(1, "Red Otter"), (2, "RedOtter Team"), (3, "Pond")], "id int, label string")
    assert [(r.id, r.label) for r in entities.others(labels, spark.createDataFrame([("red otter", 1)], "typed string, id int")).collect()] == [(2, "RedOtter Team")]


def test_release_notes_and_report(spark):
    from tarnflow.sources import publish

    a = {"schema_version": "7", "sources": {"attack": "1"}, "rows": {"stigs": 1}}
    assert publish.needs_release(None, a)[0] and publish.needs_release(a, a) == (False, [])
    assert publish.needs_release(a, {**a, "sources": {"attack": "2"}}) == (True, ["attack: 1 -> 2"])
    assert "1 of 2 checks" in publish.report(spark.createDataFrame([("x", 0), ("y", 3)], "finding string, n long"))


def test_other_content_with_equal_counts_is_a_release():
    from tarnflow.sources import publish

    old = {"sources": {}, "rows": {"stigs": 2, "ccis": 1}, "schema_version": "7", "sha256": "a", "digests": {"stigs": "x", "ccis": "y"}}
    assert publish.needs_release(old, old) == (False, [])
    assert publish.needs_release(old, old | {"sha256": "b", "digests": {"stigs": "z", "ccis": "y"}}) == (True, ["stigs: other content in 2 rows"])
    bare = {k: v for k, v in old.items() if k != "digests"}
    assert publish.needs_release(bare, old | {"sha256": "b"}) == (True, ["content: another hash"]) and publish.needs_release(bare, old) == (False, [])
