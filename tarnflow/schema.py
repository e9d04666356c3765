"""The knowledge base's 20 tables, declared once. Lists are arrays, flags booleans; dates stay text, as their order is lexical."""

from __future__ import annotations

SCHEMA_VERSION = "7"

TABLES: dict[str, tuple[list[str], str]] = {
    "techniques": (["technique_id"], "technique_id string, name string, is_subtechnique boolean, parent_id string, tactics array<string>, attack_version string, created string, ctid_status string"),
    "controls": (["control_id"], "control_id string, name string, family string, is_enhancement boolean, parent_control_id string"),
    "ccis": (["cci_id"], "cci_id string, definition string"),
    "stigs": (["stig_id", "version"], "stig_id string, version string, title string, benchmark_id string, release_info string, release_label string, product_keywords string, origin string, source_artifact string, source_member string, xccdf_status string, xccdf_status_date string"),
    "stig_rules": (["rule_id"], "rule_id string, group_id string, stig_id string, stig_version string, severity_cat string, severity_level string, title string, discussion string, fix_text string, check_text string"),
    "actors": (["actor_id"], "actor_id string, name string, aliases array<string>"),
    "technique_control": (["technique_id", "control_id", "source"], "technique_id string, control_id string, source string, source_version string, suppressed boolean"),
    "cci_control": (["cci_id", "control_id"], "cci_id string, control_id string, source_version string"),
    "rule_cci": (["rule_id", "cci_id"], "rule_id string, cci_id string"),
    "actor_technique": (["actor_id", "technique_id"], "actor_id string, technique_id string, source string, source_version string"),
    "ingest_meta": (["source_name"], "source_name string, source_version string, artifact string, ingested_at string, schema_version string"),
    "revoked_technique": (["revoked_id"], "revoked_id string, replacement_id string, revoked_name string, source_version string"),
    "source_files": (["name"], "name string, sha256 string, size long"),
    "notices": (["name"], "name string, text string"),
    "mitigations": (["mitigation_id"], "mitigation_id string, name string, description string"),
    "technique_mitigation": (["technique_id", "mitigation_id"], "technique_id string, mitigation_id string, description string"),
    "detection_strategies": (["detection_strategy_id"], "detection_strategy_id string, technique_id string, name string"),
    "data_components": (["data_component_id"], "data_component_id string, name string, description string"),
    "analytics": (["analytic_id"], "analytic_id string, detection_strategy_id string, name string, description string, platforms array<string>, mutable_elements string"),
    "analytic_log_sources": (["analytic_id", "name", "channel"], "analytic_id string, name string, channel string, data_component_id string"),
}
