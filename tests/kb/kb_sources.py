"""Small sources of our own making for the tests of the knowledge base."""

from __future__ import annotations

import io
import json
import zipfile
from pathlib import Path


def benchmark(key: str, title: str, version: str = "1", release: int = 1, date: str = "2025-01-01", rules: tuple = (("R1", "high", "CCI-000001"),), status: str = "accepted") -> str:
    groups = "".join(
        f'<Group id="V-{r}"><Rule id="{r}"{f" severity={chr(34)}{level}{chr(34)}" if level else ""}><title>Rule {r}</title><description>why {r}</description><fixtext>fix {r}</fixtext>'
        f'<check><check-content>check {r}</check-content></check>{"".join(f"<ident system={chr(34)}cci{chr(34)}>{c}</ident>" for c in ccis.split())}</Rule></Group>'
        for r, level, ccis in rules
    )
    return (
        f'<?xml version="1.0"?><!-- made up --><x:Benchmark xmlns:x="http://checklists.nist.gov/xccdf/1.1" id="{key}"><x:status date="{date}">{status}</x:status><x:title>{title}</x:title>'
        f'<x:plain-text id="other">no</x:plain-text><x:plain-text id="release-info">Release: {release} Benchmark Date: {date}</x:plain-text><x:version>{version}</x:version>{groups.replace("<", "<x:").replace("<x:/", "</x:")}</x:Benchmark>'
    )


def zipped(files: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def ref(i: str) -> list[dict]:
    return [{"source_name": "elsewhere", "external_id": "X"}, {"source_name": "mitre-attack", "external_id": i}]


def bundle() -> dict:
    objects = [{"type": "x-mitre-collection", "id": "c", "x_mitre_version": "19.2"}]
    for t, more in (("T1", {}), ("T1.001", {"x_mitre_is_subtechnique": True}), ("T2", {}), ("T9.001", {"x_mitre_is_subtechnique": True}), ("T3", {"revoked": True}), ("T4", {"revoked": True}), ("T5", {"revoked": True}), ("T6", {"revoked": True}), ("T7", {"revoked": True})):
        objects.append({"type": "attack-pattern", "id": f"ap-{t}", "name": f"Technique {t}", "created": "2020-02-03T00:00:00Z", "external_references": ref(t), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "impact"}, {"kill_chain_name": "other", "phase_name": "x"}], **more})
    objects += [{"type": "intrusion-set", "id": "g1", "name": "Red Otter", "aliases": ["Red Otter", " Brook Team "], "external_references": ref("G0001")}, {"type": "intrusion-set", "id": "g2", "name": "Red Ottar", "aliases": ["Pond"], "external_references": ref("G0002")}]
    objects += [{"type": "course-of-action", "id": "m1", "name": "Mit one", "description": "d1", "external_references": ref("M1001")}, {"type": "course-of-action", "id": "m2", "name": "Old", "external_references": ref("T1")}]
    objects += [{"type": "x-mitre-data-component", "id": "dc1", "name": "Logon", "description": "dd", "external_references": ref("DC0001")}]
    objects += [{"type": "x-mitre-analytic", "id": f"an{k}", "name": f"Analytic {k}", "description": "", "external_references": ref(f"AN000{k}"), "x_mitre_platforms": ["Windows"] if k < 3 else ["Linux"], "x_mitre_log_source_references": logs, "x_mitre_mutable_elements": [{"field": "f", "description": "t"}]} for k, logs in ((1, [{"name": " Sysmon ", "channel": " 1 ", "x_mitre_data_component_ref": "dc1"}]), (2, [{"name": "Sysmon", "channel": None}, {"name": "Audit", "channel": "2"}]), (3, []))]
    objects += [{"type": "x-mitre-detection-strategy", "id": "ds1", "name": "Strategy", "external_references": ref("DET0001"), "x_mitre_analytic_refs": ["an1", "an2", "an3", "gone"]}]
    edges = [("revoked-by", "ap-T3", "ap-T4"), ("revoked-by", "ap-T4", "ap-T2"), ("revoked-by", "ap-T5", "ap-T6"), ("revoked-by", "ap-T6", "ap-T5"), ("revoked-by", "ap-T7", "ap-T8"), ("revoked-by", "ap-T1", "ap-T2"), ("uses", "g1", "ap-T1"), ("uses", "g1", "ap-T2"), ("uses", "g1", "ap-T3"), ("mitigates", "m1", "ap-T3"), ("mitigates", "m1", "ap-T2"), ("mitigates", "m2", "ap-T1"), ("detects", "ds1", "ap-T2")]
    objects += [{"type": "relationship", "id": f"r{k}", "relationship_type": kind, "source_ref": a, "target_ref": b, "description": f"edge {k}"} for k, (kind, a, b) in enumerate(edges)]
    return {"objects": objects}


def write(folder: Path) -> dict[str, str]:
    marks = folder / "benchmarks"
    marks.mkdir(parents=True)
    rhel = (("RH1", "high", "CCI-000001"), ("RH2", "medium", "CCI-000002 CCI-000003"), ("RH3", "low", "CCI-000004"), ("RHX", "", "CCI-000001"))
    (marks / "U_RHEL_9_Manual-xccdf.xml").write_text(benchmark("RHEL_9_STIG", "Red Hat Enterprise Linux 9 Security Technical Implementation Guide", "1", 2, rules=rhel))
    newer = zipped({"a/U_RHEL_9_Manual-xccdf.xml": benchmark("RHEL_9_STIG", "Red Hat Enterprise Linux 9 Security Technical Implementation Guide", "1", 3, rules=rhel), "a/readme.txt": "x"})
    win = zipped({"w/plain.xml": benchmark("Windows_11_STIG", "Microsoft Windows 11 Security Technical Implementation Guide", "2", 1, rules=(("W1", "high", "CCI-000001"), ("RH1", "high", "CCI-000001"))), "w/other.xml": "<html/>"})
    (marks / "U_SRG-STIG_Library_July_2026.zip").write_bytes(zipped({"U_RHEL_9_V1R3_STIG.zip": newer, "U_Windows_11_V2R1_STIG.zip": win, "broken.zip": b"no zip"}))
    (marks / "U_Draft_STIG.zip").write_bytes(zipped({"d-xccdf.xml": benchmark("Draft_STIG", "A STIG", status="draft", rules=(("D1", "high", ""),))}))
    (marks / "broken-xccdf.xml").write_text("<Benchmark><unclosed>")
    (marks / "bad-xccdf.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]>' + benchmark("Evil_STIG", "Evil STIG").split("?>")[1])
    cci = "".join(f'<cci_item id="CCI-00000{k}"><definition>def {k}</definition><references>{"".join(f"<reference title={chr(34)}NIST SP 800-53 Revision {v}{chr(34)} version={chr(34)}{v}{chr(34)} index={chr(34)}{i}{chr(34)}/>" for v, i in refs)}</references></cci_item>' for k, refs in ((1, [(5, "AC-2 (1)"), (4, "AC-9")]), (2, [(5, "AC-2 a")]), (3, [(5, "AC-2 (10)"), (5, "AC-2 (10) b")]), (4, [(5, "CM-6")])))
    (folder / "cci.xml").write_text(f"<cci_list xmlns='urn:x'><metadata><version>2026-01-01</version></metadata><cci_items>{cci}</cci_items></cci_list>")
    (folder / "attack.json").write_text(json.dumps(bundle()))
    objects = [("T1", "AC-02", "mitigates", "complete"), ("T1", "AC-02", "mitigates", "complete"), ("T3", "CM-6", "mitigates", "complete"), ("T2", "AC-2", "related-to", "complete"), ("T9.001", None, None, "non_mappable"), ("T77", "AC-2", "mitigates", "complete")]
    (folder / "mapping.json").write_text(json.dumps({"metadata": {"mapping_framework_version": "rev5", "attack_version": "16.1", "last_update": "01/02/2026"}, "mapping_objects": [dict(zip(("attack_object_id", "capability_id", "mapping_type", "status"), o, strict=True)) for o in objects]}))
    (folder / "catalog.json").write_text(json.dumps({"catalog": {"metadata": {"version": "5.2"}, "groups": [{"id": "ac", "title": "Access", "controls": [{"id": "ac-2", "title": "Accounts", "controls": [{"id": "ac-2.1", "title": "Automated"}, {"id": "odd", "title": "?"}]}, {"id": "bad id", "title": "?", "controls": [{"id": "ac-3.1", "title": "orphan"}]}]}]}}))
    (folder / "overrides.yaml").write_text("add:\n  - technique: T2\n    control: AC-2\nsuppress:\n  - {technique: T1, control: CM-99}\n")
    return {"benchmarks": str(marks), "cci": str(folder / "cci.xml"), "attack": str(folder / "attack.json"), "mapping": str(folder / "mapping.json"), "catalog": str(folder / "catalog.json"), "overrides": str(folder / "overrides.yaml")}
