"""What an answer says beside its rows: reasons are decided in plans, over any number of rows, as codes; sentences are made of an answer's few."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Ids that a sentence names before it counts the rest.
MOST_NAMED = 4
_VERSIONS = {"attack": "attack", "ctid_attack_version": "mapped_for", "ctid_attack_release": "mapped_on"}


def mapping_versions(meta: DataFrame) -> DataFrame:
    """One row: the release of the technique data, the one that the mapping was made for, and that one's date; null where not recorded."""
    return meta.agg(*[F.max(F.when(F.col("source_name") == name, F.nullif(F.col("source_version"), F.lit("")))).alias(as_) for name, as_ in _VERSIONS.items()])


def provenance(stigs: DataFrame, meta: DataFrame) -> DataFrame:
    """stigs with `library` (the compilation's file, or null) and `currency`: null for guidance of the library, else why it may not be current:
    deprecated (whatever its origin), no-library, empty-library (there was one, and no benchmark is of it), sunset or local."""
    library = meta.agg(F.max(F.when(F.col("source_name") == "stig_library", F.col("artifact"))).alias("library"))
    filled = stigs.agg(F.coalesce(F.bool_or(F.col("origin") == "library"), F.lit(False)).alias("_filled"))
    facts = F.broadcast(library.crossJoin(filled))  # one row
    code = (
        F.when(F.col("xccdf_status") == "deprecated", "deprecated")
        .when(F.col("origin") == "library", None)
        .when(F.col("library").isNull(), "no-library")
        .when(~F.col("_filled"), "empty-library")
        .when(F.col("origin") == "sunset", "sunset")
        .otherwise("local")
    )
    return stigs.crossJoin(facts).withColumn("currency", code).drop("_filled")


def uncontrolled(techniques: DataFrame, technique_control: DataFrame, meta: DataFrame) -> DataFrame:
    """(technique_id, created, mapped_for, mapped_on, reason) of techniques without an effective control: suppressed (mapped, and all of it taken
    back), reviewed (nothing mitigates it), newer (than the mapping's release), uncovered, or undated, where a date is missing to tell."""
    bare = techniques.join(technique_control.filter("not suppressed").select("technique_id"), "technique_id", "left_anti")
    rows = bare.crossJoin(F.broadcast(mapping_versions(meta)))  # one row
    dated = F.col("created").isNotNull() & F.col("mapped_on").isNotNull()
    reason = (
        F.when(F.col("ctid_status") == "mapped", "suppressed")
        .when(F.col("ctid_status") == "non_mappable", "reviewed")
        .when(dated & (F.col("created") > F.col("mapped_on")), "newer")
        .when(dated, "uncovered")
        .otherwise("undated")
    )
    return rows.select("technique_id", "created", "mapped_for", "mapped_on", reason.alias("reason"))


def named(items: Iterable[str], most: int = MOST_NAMED) -> str:
    items = list(items)
    return ", ".join(items[:most]) + (f" and {len(items) - most} more" if len(items) > most else "")


def currency_note(row: Row) -> str | None:
    """A sentence on a row of provenance(), or None."""
    label = f"{row.stig_id} {row.release_label or ''}".strip()
    said = {
        "deprecated": f"{label} is marked as deprecated by its publisher since {row.xccdf_status_date}.",
        "no-library": f"No library compilation was built in, so it can't be told whether {label} is current.",
        "empty-library": f"The compilation {row.library} was built in but gave no benchmark, so it can't be told whether {label} is current.",
        "sunset": f"{label} is of a sunset compilation; {row.library} doesn't hold it.",
        "local": f"{label} ({row.release_info}) was supplied locally; {row.library} doesn't hold it, as it is newer or was left out.",
    }
    return said.get(row.currency)


def currency_notes(stigs: DataFrame, meta: DataFrame, scope: list[tuple[str, str]]) -> list[str]:
    """Sentences on the benchmarks in scope that aren't the library's current guidance."""
    if not scope:
        return []
    wanted = stigs.sparkSession.createDataFrame(scope, "stig_id string, version string")
    rows = provenance(stigs, meta).filter("currency is not null").join(wanted, ["stig_id", "version"], "left_semi").orderBy("stig_id", "version").collect()
    return [currency_note(r) for r in rows]


def uncontrolled_notes(techniques: DataFrame, technique_control: DataFrame, meta: DataFrame) -> list[str]:
    said = {
        "suppressed": "every control mapped to {0} is suppressed by an override.",
        "reviewed": "the mapping's authors reviewed {0} and found no control that mitigates it.",
        "newer": "{0} came on {1}, after release {2} ({3}) that the mapping was made for.",
        "uncovered": "the mapping doesn't cover {0}; an override can add controls.",
        "undated": "{0} isn't in the mapping (release {2}); without release dates it can't be told whether it is newer.",
    }
    rows = uncontrolled(techniques, technique_control, meta).orderBy("technique_id").collect()
    texts = [said[r.reason].format(r.technique_id, r.created, r.mapped_for or "unknown", r.mapped_on) for r in rows]
    return [t[0].upper() + t[1:] for t in texts]


def version_gap_note(meta: DataFrame) -> str | None:
    """Both releases, where the techniques' isn't the mapping's."""
    v = mapping_versions(meta).first()
    return f"Techniques are of release {v.attack}, controls of a mapping for {v.mapped_for}." if v.attack and v.mapped_for and v.attack != v.mapped_for else None


def coverage_note(verdict: dict) -> str | None:
    """A sentence on a fragment's version, unless the fragment matched with confidence by itself."""
    if verdict["fragment_confident"]:
        return None
    ids, several = verdict["benchmarks"], len(verdict["benchmarks"]) > 1
    if verdict["verdict"] == "uncovered":
        return f"No benchmark here is for '{verdict['fragment']}'; nearest: {named(ids)}, for {', '.join(verdict['covered_versions'])}. To use {'them' if several else 'it'} all the same, name benchmark_ids."
    return f"{named(ids)} {'have' if several else 'has'} no version of {'their' if several else 'its'} own, so '{verdict['fragment']}' wasn't scoped to {'them' if several else 'it'}; name benchmark_ids={ids!r} if {'they apply' if several else 'it applies'}."


def tied_note(omitted: int, description: str) -> str | None:
    return f"{omitted} more {'benchmark matches' if omitted == 1 else 'benchmarks match'} '{description}' as well as the last one listed; raise the limit or name the product more closely." if omitted else None


def ruleless_note(controls: list[str], cats: list[str] | None) -> str | None:
    """One sentence for all controls that no rule in scope reaches."""
    if not controls:
        return None
    level = f"CAT {' or CAT '.join(cats)} " if cats else ""
    return f"No {level}rules in the resolved STIGs cite {'control' if len(controls) == 1 else f'these {len(controls)} controls'} or enhancements: {', '.join(controls)}."
