"""Sources to the knowledge base's tables.

What a run needs more than once is written once, and counted as it is written (metered.py): no count() runs a plan again, and what the run
turned away is read from the same tables, with the reason.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import ids
from tarnflow.operators import arbitration, graph, rank, relational, resolver, segments
from tarnflow.operators.metered import Meter
from tarnflow.schema import SCHEMA_VERSION
from tarnflow.sources import archives, documents, rules

# Log-source names that the bundle misspells, by analytic.
LOG_SOURCE_FIXES = {("AN0272", "linus:syslog"): "linux:syslog", ("AN0364", "linuxsyslog"): "linux:syslog"}


@dataclass
class Sources:
    """Paths of what a build reads. benchmarks: a folder of loose XML and zips. corrections: id -> [(part of a path, corrected id)],
    or a rule file that also gives the corrected documents' titles. applicability: a rule file of builds, held against the benchmarks. attack_index: dates of the technique
    data's releases, without which answers can't tell a newer technique from an unmapped one."""

    benchmarks: str
    cci: str
    attack: str
    mapping: str
    catalog: str | None = None
    overrides: str | None = None
    ingested_at: str = ""
    corrections: dict[str, list[tuple[str, str]]] | str | None = None
    applicability: str | None = None
    attack_index: str | None = None


#: What the run turned away: the kind of thing, its name, why, and the document it came with.
REJECTS = ["thing", "name", "reason", "source_document"]


@dataclass
class Built:
    """tables; counters; rejects (REJECTS); meter, whose release() deletes what the tables are read from, once they are published."""

    tables: dict[str, DataFrame]
    counters: dict[str, int]
    rejects: DataFrame
    meter: Meter


def _rejected(rows: DataFrame, thing: str, name: Column, reason: Column, document: Column | None = None) -> DataFrame:
    return rows.select(F.lit(thing).alias("thing"), name.cast("string").alias("name"), reason.alias("reason"), (F.lit(None).cast("string") if document is None else document).alias("source_document"))


def attack_tables(objects: DataFrame, reviewed: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """The tables of an ATT&CK bundle. objects: documents.bundle(), held by the caller, as every table reads them."""
    tables = _attack(objects)
    return tables | {"techniques": mapping_status(tables["techniques"], reviewed, pairs, tables["revoked_technique"])}


def mapping_status(techniques: DataFrame, reviewed: DataFrame, pairs: DataFrame, moved: DataFrame) -> DataFrame:
    """techniques with ctid_status: mapped, non_mappable (reviewed, by this id or one that was moved to it) or absent."""
    mapped = pairs.select("technique_id").distinct().withColumn("_m", F.lit(1))
    ends = moved.select(F.col("revoked_id").alias("technique_id"), "replacement_id")
    read = reviewed.join(ends, "technique_id", "left").select(F.coalesce("replacement_id", "technique_id").alias("technique_id")).distinct().withColumn("_r", F.lit(1))
    status = F.when(F.col("_m") == 1, "mapped").when(F.col("_r") == 1, "non_mappable").otherwise("absent")
    return techniques.join(mapped, "technique_id", "left").join(read, "technique_id", "left").withColumn("ctid_status", status).drop("_m", "_r")


def refused_edges(objects: DataFrame) -> DataFrame:
    """(pos, source_ref, target_ref, reason) of revoked-by edges that move nothing: an end is no technique, or the source is live still."""
    ends = objects.filter("type = 'attack-pattern' and attack_id is not null").select("id", "attack_id", "live")
    edges = objects.filter("type = 'relationship' and relationship_type = 'revoked-by'").select("pos", "source_ref", "target_ref")
    both = edges.join(ends.select(F.col("id").alias("source_ref"), F.col("attack_id").alias("_s")), "source_ref", "left").join(ends.select(F.col("id").alias("target_ref"), F.col("attack_id").alias("_t")), "target_ref", "left")
    living = ends.filter("live").select(F.col("attack_id").alias("_s")).distinct().withColumn("_live", F.lit(True))
    reason = F.when(F.col("_s").isNull() | F.col("_t").isNull(), "an end is no technique").when(F.col("_live"), "the source is live")
    return both.join(living, "_s", "left").withColumn("reason", reason).filter("reason is not null").select("pos", "source_ref", "target_ref", "reason")


def live_techniques(objects: DataFrame, version: Column) -> DataFrame:
    """The live attack-patterns with an id, one of each; a parent that isn't among them is null."""
    sub = F.coalesce("x_mitre_is_subtechnique", F.lit(False))
    tactics = F.transform(F.filter(F.coalesce("kill_chain_phases", F.array()), lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"])
    patterns = objects.filter("type = 'attack-pattern' and attack_id is not null and live")
    live = patterns.select(F.col("attack_id").alias("technique_id"), F.coalesce("name", F.lit("")).alias("name"), sub.alias("is_subtechnique"), F.when(sub, F.substring_index("attack_id", ".", 1)).alias("parent_id"), tactics.alias("tactics"), version.alias("attack_version"), ids.date_part(F.col("created")).alias("created"))
    return relational.parent_repaired(live.dropDuplicates(["technique_id"]), "technique_id", "parent_id")


def _actors(objects: DataFrame) -> DataFrame:
    return objects.filter("type = 'intrusion-set' and live and attack_id is not null")


def _mitigations(objects: DataFrame) -> DataFrame:
    return objects.filter("type = 'course-of-action' and live and attack_id like 'M%'")


def attack_edges(objects: DataFrame, answers: DataFrame | None = None) -> dict[str, DataFrame]:
    """uses (pos, actor_id, technique_id) between live ends, and mitigates (pos, mitigation_id, technique_id, description) from live mitigations
    to techniques that answer for the target. answers: target_ref, technique_id; live techniques answer for themselves where it isn't given."""
    edges = objects.filter("type = 'relationship'").select("pos", "relationship_type", "source_ref", "target_ref", "description")
    direct = objects.filter("type = 'attack-pattern' and attack_id is not null and live").select(F.col("id").alias("target_ref"), F.col("attack_id").alias("technique_id"))
    uses = edges.filter("relationship_type = 'uses'").join(_actors(objects).select(F.col("id").alias("source_ref"), F.col("attack_id").alias("actor_id")), "source_ref").join(direct, "target_ref").filter("technique_id like 'T%'")
    held = edges.filter("relationship_type = 'mitigates'").join(_mitigations(objects).select(F.col("id").alias("source_ref"), F.col("attack_id").alias("mitigation_id")), "source_ref")
    held = held.join(direct if answers is None else answers, "target_ref")
    return {"uses": uses.select("pos", "actor_id", "technique_id"), "mitigates": held.select("pos", "mitigation_id", "technique_id", "description")}


def _attack(objects: DataFrame) -> dict[str, DataFrame]:
    patterns = objects.filter("type = 'attack-pattern' and attack_id is not null")
    version = F.lit((objects.filter("type = 'x-mitre-collection'").select("x_mitre_version").first() or [None])[0])
    edges = objects.filter("type = 'relationship'").select("pos", "relationship_type", "source_ref", "target_ref", "description")
    live = live_techniques(objects, version)
    refs = patterns.select(F.col("id").alias("ref"), "attack_id", "live")
    by_source, by_target = refs.select(F.col("ref").alias("source_ref"), F.col("attack_id").alias("revoked_id")), refs.select(F.col("ref").alias("target_ref"), F.col("attack_id").alias("replacement_id"))
    revoked = edges.filter("relationship_type = 'revoked-by'").join(by_source, "source_ref").join(by_target, "target_ref")
    known = patterns.select(F.col("attack_id").alias("k")).distinct()
    admitted = graph.admitted(revoked.select("pos", "revoked_id", "replacement_id"), known, live.select("technique_id"), "revoked_id", "replacement_id", "pos")
    ends = graph.closure(admitted, "revoked_id", "replacement_id", live.select("technique_id")).filter("outcome = 'resolved'").select("revoked_id", "replacement_id")
    names = patterns.groupBy(F.col("attack_id").alias("revoked_id")).agg(F.max_by("name", "pos").alias("revoked_name"))
    moved = ends.join(names, "revoked_id", "left").withColumn("source_version", version)
    answers = refs.join(ends.withColumnRenamed("revoked_id", "attack_id"), "attack_id", "left").select(F.col("ref").alias("target_ref"), F.when(F.col("live"), F.col("attack_id")).otherwise(F.col("replacement_id")).alias("technique_id")).filter("technique_id is not null")

    edge = attack_edges(objects, answers)
    actors, mitigations, uses = _actors(objects), _mitigations(objects), edge["uses"]
    pair = rank.winners(edge["mitigates"], ["technique_id", "mitigation_id"], [F.asc("pos")]).select("technique_id", "mitigation_id", "description")
    strategies = objects.filter("type = 'x-mitre-detection-strategy' and live and attack_id is not null")
    detects = edges.filter("relationship_type = 'detects'").join(strategies.select(F.col("id").alias("source_ref"), F.col("attack_id").alias("detection_strategy_id"), "name"), "source_ref").join(answers, "target_ref")
    detects = rank.winners(detects, ["detection_strategy_id"], [F.asc("pos")]).select("detection_strategy_id", "technique_id", "name")
    components = objects.filter("type = 'x-mitre-data-component' and live and attack_id is not null")
    analytics = objects.filter("type = 'x-mitre-analytic' and live and attack_id is not null").select(F.col("id").alias("ref"), "attack_id", "name", "description", "x_mitre_platforms", "x_mitre_log_source_references", "x_mitre_mutable_elements")
    held = strategies.select(F.col("attack_id").alias("detection_strategy_id"), "pos", F.posexplode("x_mitre_analytic_refs").alias("k", "ref")).join(detects.select("detection_strategy_id"), "detection_strategy_id", "left_semi").join(analytics, "ref")
    held = rank.winners(held, ["attack_id"], [F.asc("pos"), F.asc("k")])
    fixed = F.col("name_")
    for (analytic, wrong), right in LOG_SOURCE_FIXES.items():
        fixed = F.when((F.col("analytic_id") == analytic) & (F.col("name_") == wrong), right).otherwise(fixed)
    logs = held.select(F.col("attack_id").alias("analytic_id"), F.posexplode("x_mitre_log_source_references").alias("k", "l")).select("analytic_id", "k", F.trim(F.coalesce("l.name", F.lit(""))).alias("name_"), F.trim(F.coalesce("l.channel", F.lit(""))).alias("channel"), F.col("l.x_mitre_data_component_ref").alias("ref"))
    logs = logs.withColumn("name", fixed).join(components.select(F.col("id").alias("ref"), F.col("attack_id").alias("data_component_id")), "ref", "left")
    logs = rank.winners(logs, ["analytic_id", "name", "channel"], [F.asc("k")]).select("analytic_id", "name", "channel", "data_component_id")
    return {
        "techniques": live, "revoked_technique": moved,
        "actors": actors.select(F.col("attack_id").alias("actor_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")).dropDuplicates(["actor_id"]),
        "actor_technique": uses.select("actor_id", "technique_id").distinct().withColumn("source", F.lit("attack")).withColumn("source_version", version),
        "mitigations": mitigations.select(F.col("attack_id").alias("mitigation_id"), "name", "description").dropDuplicates(["mitigation_id"]),
        "technique_mitigation": pair, "detection_strategies": detects,
        "data_components": components.select(F.col("attack_id").alias("data_component_id"), "name", "description").dropDuplicates(["data_component_id"]),
        "analytics": held.select(F.col("attack_id").alias("analytic_id"), "detection_strategy_id", "name", "description", F.coalesce("x_mitre_platforms", F.array().cast("array<string>")).alias("platforms"), F.to_json(F.coalesce("x_mitre_mutable_elements", F.array().cast("array<map<string,string>>"))).alias("mutable_elements")),
        "analytic_log_sources": logs,
    }


def effective_pairs(mapped: DataFrame, added: DataFrame, suppressed: DataFrame, ends: DataFrame) -> DataFrame:
    """(technique_id, control_id, source, remapped): upstream pairs moved along revocations, less tombstones (moved too), and the operator's
    own. A tombstone never removes an own pair; a native pair wins over a moved one."""

    def moved(df: DataFrame) -> DataFrame:
        return df.join(ends.withColumnRenamed("revoked_id", "technique_id"), "technique_id", "left").select(F.coalesce("replacement_id", "technique_id").alias("technique_id"), "control_id", F.col("replacement_id").isNotNull().alias("remapped"), F.col("technique_id").alias("original"))

    upstream = moved(mapped).join(moved(suppressed).select("technique_id", "control_id").distinct(), ["technique_id", "control_id"], "left_anti").withColumn("source", F.lit("ctid"))
    both = upstream.unionByName(moved(added).withColumn("source", F.lit("override")))
    return rank.winners(both, ["technique_id", "control_id", "source"], [F.asc("remapped"), F.asc("original")]).drop("original")


def drift(stigs: DataFrame, entries: list) -> DataFrame:
    """(entry, version, finding, stig_rows) of rules of builds held against (stig_id, version): unmapped versions that an entry governs and no
    threshold names, absent ones that a threshold names and no governed row has, and, with a null version, idle entries that govern nothing.
    stig_rows: governed rows of the version. Entries are a rule file's few, so each is a filter."""
    spark, found = stigs.sparkSession, []
    for name, pattern, _, steps in entries:
        named = spark.createDataFrame([(v,) for v in sorted({v for _, v in steps if v is not None})], "version string").withColumn("_named", F.lit(True))
        held = stigs.filter(F.col("stig_id").rlike(pattern)).groupBy("version").agg(F.count("*").alias("stig_rows"))
        each = held.join(named, "version", "full").withColumn("finding", F.when(F.col("_named").isNull(), "unmapped").when(F.col("stig_rows").isNull(), "absent"))
        none = held.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("version"), F.lit("idle").alias("finding"), F.lit(None).cast("long").alias("stig_rows"))
        judged = each.filter("finding is not null").join(none.select(F.lit(True).alias("_idle")), F.lit(True), "left_anti").select("version", "finding", "stig_rows")
        found.append(judged.unionByName(none).select(F.lit(name).alias("entry"), "version", "finding", F.coalesce("stig_rows", F.lit(0)).alias("stig_rows")))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "entry string, version string, finding string, stig_rows long")


def benchmark_tables(found: DataFrame, corrections: dict | None = None, titles: dict[str, str] | None = None, meter: Meter | None = None) -> Built:
    """stigs, stig_rules and rule_cci, with counters and rejects. found: archives.benchmark_documents(); titles: those of corrected ids.

    Four tables are held: documents as parsed, settled, those that won, and their rules with who holds them."""
    meter = meter or Meter(found.sparkSession)
    read = documents.benchmarks(found.withColumn("path", F.col("source_document")))
    read = read.withColumn("kind", F.when(F.col("stig_id").isNull(), "unreadable").otherwise(ids.document_kind(F.col("status"), F.col("stig_id"), F.col("title"))))
    kinds = {"unreadable": "unreadable", "kind_stig": "stig", "skipped_srg": "srg", "skipped_draft": "draft", "skipped_unclassified": "neither"}
    parsed = meter.held(read, "stig_files", **{c: F.col("kind") == k for c, k in kinds.items()})
    wanted = parsed.filter("kind = 'stig'").withColumn("arrival", F.concat_ws("\0", "source_artifact", F.coalesce("source_member", F.lit("")), "source_document"))
    wanted = wanted.withColumn("major", ids.major(F.col("version"))).withColumn("is_library", F.col("origin") == "library")
    wanted = wanted.withColumn("release", F.struct(F.col("major"), ids.release_number(F.col("release_info")).alias("number")))
    rule_ids = F.flatten(F.transform(F.coalesce("groups", F.array()), lambda g: F.coalesce(F.transform(g["Rule"], lambda r: r["_id"]), F.array().cast("array<string>"))))
    claiming = wanted.withColumn("rules", rule_ids).withColumn("artifact", F.col("source_artifact")).withColumn("path", F.col("source_document"))
    settled = arbitration.settled(claiming, corrections, lambda rows: meter.held(rows, "settled", **arbitration.counted(rows)))
    # The published id stays beside the one that a correction gave.
    winners = settled.winners.join(settled.departures, ["final_id", "version"], "left").withColumn("benchmark_id", F.col("stig_id")).withColumn("stig_id", F.col("final_id")).drop("rules", "final_id", "turn", "pair")
    corrected = F.col("stig_id") != F.col("benchmark_id")
    for new, title in (titles or {}).items():  # a rule file's few
        winners = winners.withColumn("title", F.when(corrected & (F.col("stig_id") == new), F.lit(title)).otherwise(F.col("title")))
    winners = meter.held(winners, "winners", by_library=F.col("superseded_by_library"), by_same_key=F.col("superseded_same_key"), id_corrections_applied=F.col("verdict") == "split")
    kept = meter.held(rank.lifecycle(winners, "stig_id", major="major", is_library="is_library"), "stigs")
    rows = documents.rules(kept, ["stig_id", "version", "major", "is_library", "status_date", "source_document"])
    order = [F.desc_nulls_last("status_date"), F.desc("is_library"), F.asc("stig_id"), F.desc("major"), F.asc("group_pos"), F.asc("rule_pos")]
    # Rules without a severity claim nothing from the others: they are a key of their own, and lie in the same table.
    claimed = segments.firsts(rows, ["rejected", "rule_id"], order, ["stig_id"])
    held_rule, elsewhere = F.col("held") & ~F.col("rejected"), ~F.col("held") & ~F.col("rejected")
    claimed = meter.held(claimed, "rules", unknown_severity=F.col("rejected"), stig_rules=held_rule, rule_id_collisions=elsewhere)
    held = claimed.filter(held_rule)
    stigs = kept.select("stig_id", "version", "title", "benchmark_id", "release_info", ids.release_label(F.col("version"), F.col("release_info")).alias("release_label"), ids.keywords(F.col("title"), F.col("stig_id")).alias("product_keywords"), "origin", "source_artifact", "source_member", F.col("status").alias("xccdf_status"), F.col("status_date").alias("xccdf_status_date"))
    tables = {"stigs": stigs, "stig_rules": held.withColumn("stig_version", F.col("version")), "rule_cci": held.select("rule_id", F.explode("ccis").alias("cci_id"))}
    n, document = meter.counts, F.col("source_document")
    origin = F.coalesce("source_document", "source_member", "source_artifact")  # a damaged archive has no document
    counters = {k: n[k] for k in ("stig_files", "stigs", "stig_rules", "rule_id_collisions", "unknown_severity", "unreadable", "skipped_srg", "skipped_draft", "skipped_unclassified", "id_corrections_applied")}
    counters |= {
        "superseded_by_library": n["by_library"], "superseded_same_key": n["by_same_key"] + n["discarded"], "same_key_departures": n["by_library"] + n["by_same_key"] + n["discarded"],
        "same_key_content_collision": n["content_collisions"], "same_key_collision_unmapped": n["kept_together"] + n["discarded"], "superseded_by_newer_major": n["winners"] - n["stigs"],
    }
    counters |= {"rules_skipped": n["unknown_severity"], "rules_held_elsewhere": n["rule_id_collisions"], "not_selected": counters["superseded_by_newer_major"], "superseded": counters["same_key_departures"]}
    counters |= {"kind_stig": n["kind_stig"], "kind_srg": n["skipped_srg"], "kind_draft": n["skipped_draft"], "kind_neither": n["skipped_unclassified"]}
    gone = winners.join(kept.select("stig_id", "version"), ["stig_id", "version"], "left_anti")
    rejects = [
        _rejected(parsed.filter("kind <> 'stig'"), "document", F.col("stig_id"), F.concat_ws(": ", "kind", "problem"), origin),
        _rejected(settled.documents.filter("final_id is null"), "document", F.col("stig_id"), F.lit("collides and has no other id"), document),
        _rejected(gone, "document", F.col("stig_id"), F.lit("an older major"), document),
        _rejected(claimed.filter("rejected"), "rule", F.col("rule_id"), F.lit("no severity"), document),
        _rejected(claimed.filter(elsewhere), "rule", F.col("rule_id"), F.concat(F.lit("held by "), F.col("holder_stig_id")), document),
    ]
    return Built(tables, counters, reduce(DataFrame.unionByName, rejects), meter)


def run(spark: SparkSession, sources: Sources) -> Built:
    """The whole build. What it holds is deleted again if it fails."""
    meter = Meter(spark)
    try:
        return _run(spark, sources, meter)
    except Exception:
        meter.release()
        raise


def _run(spark: SparkSession, sources: Sources, meter: Meter) -> Built:
    entries = rules.entries(spark, sources.applicability) if sources.applicability else []
    files = archives.classified(archives.listing(spark, sources.benchmarks))
    library = archives.one_library(files)
    corrections, titles = rules.corrections(spark, sources.corrections) if isinstance(sources.corrections, str) else (sources.corrections, {})
    built = benchmark_tables(archives.benchmark_documents(files), corrections, titles, meter)
    tables, counters, rejects = built.tables, built.counters, [built.rejects]
    if not counters["stigs"]:
        raise ValueError("no benchmark could be read")
    cci = meter.held(documents.cci_list(spark, sources.cci), "ccis")
    tables["ccis"], tables["cci_control"] = cci.select("cci_id", "definition"), cci.select("cci_id", F.explode("controls").alias("control_id")).withColumn("source_version", F.lit("Revision 5"))
    mapped, reviewed, label = documents.mappings(spark, sources.mapping)
    added, suppressed = documents.overrides(spark, sources.overrides, named=sources.overrides is not None)
    old = (F.col("type") == "course-of-action") & F.col("live") & ~F.coalesce(F.startswith("attack_id", F.lit("M")), F.lit(False))
    objects = meter.held(documents.bundle(spark, sources.attack), "attack_objects", mitigations_skipped=old)
    attack = _attack(objects)
    for table in ("techniques", "mitigations", "detection_strategies", "analytics", "analytic_log_sources"):
        attack[table] = meter.held(attack[table], table)
    attack["revoked_technique"] = meter.held(attack["revoked_technique"], "revocations")
    for empty in ("mitigations", "detection_strategies"):
        if not meter.counts[empty]:
            raise ValueError(f"the bundle has no {empty}")
    known = attack["techniques"].select("technique_id").withColumn("known", F.lit(True))
    pairs = effective_pairs(mapped, added, suppressed, attack["revoked_technique"].select("revoked_id", "replacement_id"))
    pairs = pairs.join(known, "technique_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    of = {s: F.col("source") == s for s in ("ctid", "override")}
    seen = {f"orphan_{s}_pairs": c & ~F.col("known") for s, c in of.items()} | {f"remapped_{s}_pairs": c & F.col("remapped") for s, c in of.items()}
    judged = meter.held(pairs, "pairs", **seen)
    pairs = judged.filter("known")
    attack["techniques"] = mapping_status(attack["techniques"], reviewed, pairs.filter("source = 'ctid'"), attack["revoked_technique"])
    tables |= attack
    tables["technique_control"] = pairs.select("technique_id", "control_id", "source", F.lit(label).alias("source_version"), F.lit(False).alias("suppressed"))
    controls = documents.control_catalog(spark, sources.catalog) if sources.catalog else spark.createDataFrame([], "control_id string, name string, family string, is_enhancement boolean, parent_control_id string")
    refs = tables["cci_control"].select("control_id").union(tables["technique_control"].select("control_id"))
    made = {"family": F.substring_index("control_id", "-", 1), "is_enhancement": F.contains("control_id", F.lit("("))}
    tables["controls"] = relational.completed(controls.dropDuplicates(["control_id"]), "control_id", refs, "control_id", made)
    tables["rule_cci"] = relational.without_orphans(tables["rule_cci"].distinct(), "cci_id", tables["ccis"], "cci_id")
    tables["source_files"], tables["notices"] = archives.source_files(files), archives.notices(files)
    attack_version = objects.filter("type = 'x-mitre-collection'").select("x_mitre_version").first()
    meta = [("attack", attack_version[0] if attack_version else None, sources.attack), ("ctid", label, sources.mapping), ("cci", documents.cci_list_version(spark, sources.cci), sources.cci)]
    if sources.catalog:
        meta.append(("nist", documents.catalog_version(spark, sources.catalog), sources.catalog))
    made_for = documents.mapping_framework(spark, sources.mapping)
    meta.append(("ctid_attack_version", made_for, sources.mapping))
    if dated := archives.release_dates(spark, sources.attack_index).get(made_for):
        meta.append(("ctid_attack_release", dated, sources.attack_index))
    if library:
        year, month = spark.range(1).select(ids.library_order(F.lit(library)).alias("o")).first().o
        meta.append(("stig_library", f"{year:04}-{month:02}" if year else None, library))
    ledger = spark.createDataFrame(meta, "source_name string, source_version string, artifact string")
    per = tables["stigs"].select(F.concat_ws(":", F.lit("stig"), "stig_id", "version").alias("source_name"), F.col("release_label").alias("source_version"), F.col("source_artifact").alias("artifact"))
    tables["ingest_meta"] = ledger.unionByName(per).withColumn("ingested_at", F.lit(sources.ingested_at)).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    known_tokens = resolver.frequencies(resolver.corpus(tables["stigs"]))
    meter.held(relational.distinctive_band(known_tokens, "df", F.lit(counters["stigs"] * resolver.DISTINCTIVE), 1), "distinctiveness_margin_tokens")
    meter.held(drift(tables["stigs"], entries), "applicability", applicability_unmapped_rows=F.when(F.col("finding") == "unmapped", F.col("stig_rows")))
    more = ("techniques", "revocations", "mitigations", "detection_strategies", "analytics", "analytic_log_sources", "ccis", "mitigations_skipped", *seen, "applicability_unmapped_rows", "distinctiveness_margin_tokens")
    counters |= {k: meter.counts[k] for k in more}
    counters |= {f"{k}_pairs": counters[f"{k}_ctid_pairs"] + counters[f"{k}_override_pairs"] for k in ("orphan", "remapped")}
    rejects += [
        _rejected(files.filter("kind is null"), "file", F.col("name"), F.lit("in no class"), F.col("path")),
        _rejected(judged.filter("not known"), "pair", F.concat_ws(" ", "technique_id", "control_id"), F.concat(F.lit("no such technique, from "), F.col("source"))),
        _rejected(objects.filter(old), "mitigation", F.coalesce("attack_id", "id"), F.lit("no id of a mitigation")),
        _rejected(refused_edges(objects), "revocation", F.concat_ws(" ", "source_ref", "target_ref"), F.col("reason")),
    ]
    return replace(built, rejects=reduce(DataFrame.unionByName, rejects))


def build(spark: SparkSession, sources: Sources) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """All tables of the knowledge base and the build's counters. run() also gives what was turned away, and releases what the tables lie in."""
    built = run(spark, sources)
    return built.tables, built.counters


def source_versions(meta: DataFrame) -> DataFrame:
    """One row, a map of every source's version, benchmarks left out."""
    rest = meta.filter(~F.startswith("source_name", F.lit("stig:")))
    return rest.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_name", "source_version")))).alias("versions"))


