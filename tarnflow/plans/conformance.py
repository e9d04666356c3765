"""Checks of a whole corpus as findings: (severity, phase, name, message), found by plans over all documents, and a report of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions import ids
from tarnflow.operators import relational, resolver
from tarnflow.plans.build import Built
from tarnflow.sources.publish import _fs

SEVERITIES = ("error", "warning", "info")


def _finding(rows: DataFrame, severity: str, phase: str, name: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(phase).alias("phase"), name.cast("string").alias("name"), message.alias("message"))


def parse_findings(parsed: DataFrame) -> DataFrame:
    """Of documents.benchmarks(): documents that can't be read, releases that aren't said (they would lose every contest), labels without
    version and release number. A document may have two."""
    read = parsed.filter("stig_id is not null")
    label = ids.release_label(F.col("version"), F.col("release_info"))
    return reduce(DataFrame.unionByName, [
        _finding(parsed.filter("stig_id is null"), "error", "parse", F.col("source_document"), F.lit("can't be read")),
        _finding(read.filter(F.trim(F.coalesce("release_info", F.lit(""))) == ""), "error", "parse", F.col("stig_id"), F.concat(F.lit("says no release, in "), F.col("source_document"))),
        _finding(read.filter(~F.coalesce(F.startswith(label, F.lit("V")), F.lit(False))), "warning", "parse", F.col("stig_id"), F.concat(F.lit("has no label of version and release but '"), F.coalesce(label, F.lit("")), F.lit("'"))),
    ])


def padded_versions(stigs: DataFrame) -> DataFrame:
    """(stig_id, padded): sorted version tokens with a leading zero that the title doesn't write as a minor alone. Requests are unpadded and
    benchmarks aren't, so a request for such a version is told that it isn't held. One row for each benchmark and list."""
    docs = resolver.corpus(stigs)
    parts = F.transform("written", lambda r: F.split(r, r"\."))
    majors, minors = F.transform(parts, lambda p: F.get(p, 0)), F.flatten(F.transform(parts, lambda p: F.slice(p, 2, F.greatest(F.size(p), F.lit(1)))))
    tagged = docs.withColumn("_majors", majors).withColumn("_minors", minors)
    padded = F.array_sort(F.filter("covered", lambda v: v.rlike("^0[0-9]+$") & (~F.array_contains("_minors", v) | F.array_contains("_majors", v))))
    return tagged.select("stig_id", padded.alias("padded")).filter(F.size("padded") > 0).distinct()


def resolver_findings(stigs: DataFrame, width: int = 1) -> DataFrame:
    """Padded versions (errors), word pairs that keep a title whole, and tokens near the gate of distinctiveness, with the benchmarks that hold
    them (infos, one each, so that one more or less shows in the counts)."""
    known = resolver.frequencies(resolver.corpus(stigs)).crossJoin(F.broadcast(stigs.agg(F.count("*").alias("n"))))  # one row
    band = relational.distinctive_band(known, "df", F.col("n") * resolver.DISTINCTIVE, width)
    return reduce(DataFrame.unionByName, [
        _finding(padded_versions(stigs), "error", "resolver", F.col("stig_id"), F.concat(F.lit("has padded versions: "), F.array_join("padded", ", "))),
        _finding(resolver.straddling_pairs(stigs), "info", "resolver", F.concat_ws("/", "before", "after"), F.lit("isn't split at its separator")),
        _finding(band, "info", "resolver", F.col("token"), F.concat(F.lit("is "), F.col("side"), F.lit(" the gate by little: "), F.col("df").cast("string"), F.lit(" of "), F.col("n").cast("string"))),
    ])


def accounting_findings(built: Built) -> DataFrame:
    """What a build turned away, with the reason: files in no class as errors, the rest as warnings."""
    rejects = built.rejects
    message = F.concat_ws(", in ", "reason", "source_document")
    lost = (F.col("thing") == "file") | F.startswith("reason", F.lit("unreadable"))
    name = F.concat_ws(" ", "thing", "name")
    return _finding(rejects.filter(lost), "error", "accounting", name, message).unionByName(_finding(rejects.filter(~lost), "warning", "accounting", name, message))


def findings_of(built: Built) -> DataFrame:
    """All findings of a build."""
    return accounting_findings(built).unionByName(resolver_findings(built.tables["stigs"]))


def counted(findings: DataFrame) -> dict[str, int]:
    """Findings of each severity."""
    found = {r.severity: r["count"] for r in findings.groupBy("severity").count().collect()}
    return {s: found.get(s, 0) for s in SEVERITIES}


def write_report(findings: DataFrame, counters: dict[str, dict[str, int]], path: str) -> dict[str, int]:
    """Write path/report.md (counts of each severity and each build's counters) and path/findings (all findings as JSON lines, errors first);
    returns the counts. counters: build -> its counters. A folder that is there is an error."""
    spark = findings.sparkSession
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    findings.orderBy(order, "phase", "name", "message").write.json(f"{path}/findings")
    counts = counted(spark.read.schema("severity string").json(f"{path}/findings"))
    lines = ["# Conformance of the corpus", "", ", ".join(f"{n} {s}" for s, n in counts.items()), "", "All findings are in `findings`."]
    for label, numbers in counters.items():
        lines += ["", f"## Counters of {label}", "", "| Counter | Number |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in sorted(numbers.items())]]
    fs, at = _fs(spark, f"{path}/report.md")
    out = fs.create(at, False)
    out.write(bytearray("\n".join([*lines, ""]).encode()))
    out.close()
    return counts
