"""A knowledge base from small sources, published, opened and asked."""

from __future__ import annotations

import pytest
from kb_sources import write

from tarnflow.operators import resolver
from tarnflow.plans import questions as q
from tarnflow.plans.build import Sources, build
from tarnflow.sources import publish


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    tables, counters = build(spark, Sources(**write(folder)))
    root = str(tmp_path_factory.mktemp("kb"))
    rows = publish.publish(spark, tables, root)
    kb = publish.KnowledgeBase(spark, root)
    return kb, counters, rows, root


def test_counters_and_rows(built):
    _, counters, rows, _ = built
    assert counters["unreadable"] == 3 and counters["kind_draft"] == 1  # broken zip, unclosed XML, document type
    assert counters["rules_skipped"] == 1 and counters["rules_held_elsewhere"] == 1 and counters["superseded"] == 1
    assert counters["orphan_pairs"] == 1 and counters["remapped_pairs"] == 1
    assert rows["stigs"] == 2 and rows["techniques"] == 4 and rows["revoked_technique"] == 2 and rows["mitigations"] == 1


def test_newest_release_and_library_win(built):
    kb = built[0].acquire()
    stig = kb["stigs"].filter("stig_id = 'RHEL_9_STIG'").first()
    assert (stig.release_label, stig.origin) == ("V1R3", "library")
    assert stig.product_keywords == "red hat enterprise linux 9 security technical implementation guide rhel 9 stig"


def test_redirects_reach_their_end(built):
    kb = built[0].acquire()
    assert {(r.revoked_id, r.replacement_id) for r in kb["revoked_technique"].collect()} == {("T3", "T2"), ("T4", "T2")}
    pairs = {(r.technique_id, r.control_id, r.source) for r in kb["technique_control"].collect()}
    assert pairs == {("T1", "AC-2", "ctid"), ("T2", "CM-6", "ctid"), ("T2", "AC-2", "override")}
    status = {r.technique_id: r.ctid_status for r in kb["techniques"].collect()}
    assert status == {"T1": "mapped", "T1.001": "absent", "T2": "mapped", "T9.001": "non_mappable"}
    parents = {r.technique_id: r.parent_id for r in kb["techniques"].collect()}
    assert parents["T1.001"] == "T1" and parents["T9.001"] is None


def test_first_edge_wins_and_channels_are_never_null(built):
    kb = built[0].acquire()
    assert [r.description for r in kb["technique_mitigation"].collect()] == ["edge 9"]
    logs = {(r.analytic_id, r["name"], r.channel, r.data_component_id) for r in kb["analytic_log_sources"].collect()}
    assert logs == {("AN0001", "Sysmon", "1", "DC0001"), ("AN0002", "Sysmon", "", None), ("AN0002", "Audit", "2", None)}


def test_controls_are_completed(built):
    kb = built[0].acquire()
    rows = {r.control_id: (r["name"], r.is_enhancement) for r in kb["controls"].collect()}
    assert rows == {"AC-2": ("Accounts", False), "AC-2(1)": ("Automated", True), "AC-2(10)": (None, True), "CM-6": (None, False)}


def test_defenses_roll_up_enhancements(built):
    kb = built[0].acquire()
    got = q.defenses_for_technique(kb, "T3", benchmark_ids=["RHEL_9_STIG", "nothing"], platforms=["windows"], log_sources=["sysmon"])
    assert got["technique"]["redirected_from"] == "T3"
    assert got["protect"]["controls"]["AC-2"]["rules"] == ["RH1", "RH2"] or set(got["protect"]["controls"]["AC-2"]["rules"]) == {"RH1", "RH2"}
    assert got["protect"]["controls"]["AC-2"]["via"] == {"AC-2(1)": ["RH1"]}  # RH2 cites AC-2 itself
    assert got["protect"]["controls"]["AC-2"]["source"] == ["override"]
    assert got["summary"]["by_cat"] == {"I": 1, "II": 1, "III": 1} and got["summary"]["cat_i"]["ids"] == ["V-RH1"]
    assert got["detect"]["applicable"] == ["AN0001", "AN0002"] and got["detect"]["detectable"] == ["AN0001"]
    assert "title" not in got["protect"]["findings"]["RH2"] and "title" in got["protect"]["findings"]["RH1"]
    assert any("nothing" in n for n in got["notes"])


def test_absent_is_not_empty(built):
    kb = built[0].acquire()
    got = q.defenses_for_technique(kb, "T2")
    assert "applicable" not in got["detect"] and "detectable" not in got["detect"] and got["protect"]["findings"] == {}
    with pytest.raises(q.CallerError):
        q.defenses_for_technique(kb, "T404")
    with pytest.raises(q.CallerError):
        q.defenses_for_technique(kb, "T2", platforms=["BeOS"])
    with pytest.raises(q.CallerError):
        q.defenses_for_technique(kb, "T2", severity=["IV"])


def test_actor_coverage(built):
    kb = built[0].acquire()
    got = q.techniques_for_actor(kb, "brook team", benchmark_ids=["RHEL_9_STIG"], include_defenses=True, platforms=["Linux"], log_sources=["Audit"])
    assert got["actor"]["id"] == "G0001" and [t["technique_id"] for t in got["techniques"]] == ["T1", "T2"]
    assert got["summary"]["coverage"] == {"techniques": 2, "without_mitigation": 1, "mitigated_without_rules": 0, "without_applicable_analytic": 1, "detectable": 0, "undetectable": 1}
    with pytest.raises(q.CallerError, match="Closest"):
        q.techniques_for_actor(kb, "Red Otters")
    assert q.resolved_actor(kb, "g0002")["id"] == "G0002"
    assert q.resolved_actor(kb, "Red-Otter Group")["tier"] == 3


def test_details(built):
    kb = built[0].acquire()
    got = q.finding_details(kb, [" v-rh1", "RH2", "nope", "rh1"])
    assert [f["rule_id"] for f in got["findings"]] == ["RH1", "RH2"] and got["not_found"] == ["nope"] and got["findings"][1]["ccis"] == ["CCI-000002", "CCI-000003"]
    d = q.defense_details(kb, ["m1001", "DET0001", "AN0002", "zz"], "T2")
    assert d["mitigations"][0]["technique_count"] == 1 and d["not_found"] == ["zz"] and len(d["detection_strategies"][0]["analytics"]) == 3
    assert d["analytics"][0]["mutable_elements"] == [{"field": "f", "description": "t"}]


def test_search_and_list(built):
    kb = built[0].acquire()
    assert [(h["technique_id"], h["score"], h["redirected_from"]) for h in q.search_techniques(kb, "t3")] == [("T2", 50, "T3")]
    assert [h["score"] for h in q.search_techniques(kb, "technique t1")] == [100, 60]
    assert [s["stig_id"] for s in q.list_stigs(kb, "rhel 9")] == ["RHEL_9_STIG"]
    assert [s["stig_id"] for s in q.list_stigs(kb, "windows_11")] == ["Windows_11_STIG"]


def test_resolver(built):
    kb = built[0].acquire()
    rules = resolver.Rules(aliases={"Windows_11_STIG": ["win 11"]}, entries=[("rhel", "^RHEL", r"\bu(?P<n>\d+)\b", [(2, "2"), (1, "1"), (0, None)])])
    got = q.resolve_system(kb, "win 11 and RHEL 9 u1", rules=rules)["candidates"]
    assert {(c["stig_id"], c["matched_on"]) for c in got} == {("Windows_11_STIG", "alias:win 11"), ("RHEL_9_STIG", "keyword")}
    assert next(c for c in got if c["stig_id"] == "RHEL_9_STIG")["reason"] == "scoped"
    assert q.resolve_system(kb, "RHEL 9", rules=rules)["candidates"][0]["reason"] == "ambiguous-no-build"
    assert resolver.split("Display and Search, Tool and RHEL 9", {("display", "search")}) == ["Display and Search", "Tool", "RHEL 9"]


def test_publish_is_atomic_and_reloads(built, spark, tmp_path):
    kb, _, _, root = built
    first = kb.acquire()
    before = publish.pointer(spark, root)["build"]
    with pytest.raises(Exception):
        publish.publish(spark, {"stigs": spark.range(1).selectExpr("assert_true(false) as stig_id")}, root)
    assert publish.pointer(spark, root)["build"] == before and publish.readiness(spark, root) == "ready"
    publish.install(spark, before, root, publish.content_hash(spark, before))
    assert kb.acquire()["stigs"].count() == first["stigs"].count() and kb.build != before
    assert publish.readiness(spark, str(tmp_path)) == "no_knowledge_base"
    doc = publish.release_doc(spark, root, "kb-7", "2026-07-01")
    assert doc["rows"]["stigs"] == 2 and doc["sources"]["attack"] == "19.2" and len(doc["sha256"]) == 64
    with pytest.raises(ValueError):
        publish.install(spark, before, root, "0" * 64)


def test_compact_json():
    assert publish.compact({"é": [1, None]}) == '{"é":[1,null]}'


def test_check_sources(built):
    kb = built[0].acquire()
    assert q.check_sources(kb, {"attack": "19.2"}) == {"action": "none", "sources": {"attack": "same"}}
    assert q.check_sources(kb, {"attack": "19.10"})["action"] == "install"
    assert q.check_sources(None, {})["action"] == "install"
