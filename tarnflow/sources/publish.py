"""A knowledge base on disk: written aside, published by one pointer, opened by it, checked before it is taken."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import digest, resolver
from tarnflow.schema import SCHEMA_VERSION, TABLES

#: The folder of a build's corpus index.
CORPUS = "corpus_index"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def shaped(df: DataFrame, table: str) -> DataFrame:
    """df with exactly the table's columns and types."""
    want = df.sparkSession.createDataFrame([], TABLES[table][1]).schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def _version(build: str) -> str:
    """A build's name, which its corpus index carries."""
    return build.rstrip("/").rpartition("/")[2]


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Write every table under a new build folder, then point root/CURRENT at it in one overwriting rename. Returns each table's rows.

    A failed build leaves the pointer, and so the published tables, as they were.
    """
    build = f"{root.rstrip('/')}/builds/{uuid.uuid4().hex}"
    fs, at = _fs(spark, build)
    counts = {}
    try:
        for name in TABLES:
            df = tables.get(name)
            shaped(df, name).write.parquet(f"{build}/{name}") if df is not None else spark.createDataFrame([], TABLES[name][1]).write.parquet(f"{build}/{name}")
        digests = {}
        for name, (_, schema) in TABLES.items():  # what was written is read once more, and its digest counts the rows
            digests[name], counts[name] = digest.digest(spark.read.schema(schema).parquet(f"{build}/{name}"))
        resolver.Corpus.written(spark.read.schema(TABLES["stigs"][1]).parquet(f"{build}/stigs"), f"{build}/{CORPUS}", _version(build))
    except Exception:
        fs.delete(at, True)
        raise
    _write_pointer(spark, root, {"build": build, "schema_version": SCHEMA_VERSION, "rows": counts, "digests": digests})
    return counts


def _write_pointer(spark: SparkSession, root: str, note: dict) -> None:
    """Write the pointer aside and give it its name in one rename over the old one: a reader sees the old or the new, never none."""
    jvm = spark._jvm
    fs, at = _fs(spark, f"{root.rstrip('/')}/CURRENT")
    aside = _fs(spark, f"{root.rstrip('/')}/.CURRENT-{uuid.uuid4().hex}")[1]
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(note).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    over = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(at), over)
    except Exception:
        fs.delete(aside, False)
        raise


def pointer(spark: SparkSession, root: str) -> dict | None:
    fs, at = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(at):
        return None
    return json.loads(spark.read.text(f"{root}/CURRENT").first().value)


def readiness(spark: SparkSession, root: str) -> str:
    """ready, no_knowledge_base, schema_outdated or unreadable."""
    try:
        found = pointer(spark, root)
    except Exception:
        return "unreadable"
    if found is None:
        return "no_knowledge_base"
    if found.get("schema_version") != SCHEMA_VERSION:
        return "schema_outdated"
    fs, _ = _fs(spark, root)
    return "ready" if all(fs.exists(_fs(spark, f"{found['build']}/{t}")[1]) for t in [*TABLES, f"{CORPUS}/meta"]) else "unreadable"


class KnowledgeBase:
    """The published tables; acquire() opens them anew when another build has been published."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.build, self.tables = spark, root, None, {}

    def acquire(self) -> dict[str, DataFrame]:
        state = readiness(self.spark, self.root)
        if state != "ready":
            raise LookupError(state)
        build = pointer(self.spark, self.root)["build"]
        if build != self.build:
            # The index lies in the build's folder and names the build, so that a request never meets another build's words.
            corpus = resolver.Corpus.opened(self.spark, f"{build}/{CORPUS}", _version(build))
            self.tables = {t: self.spark.read.schema(s).parquet(f"{build}/{t}") for t, (_, s) in TABLES.items()} | {"corpus": corpus}
            self.build = build
        return self.tables


def content_hash(spark: SparkSession, build: str) -> str:
    """One hash of the rows of all of a build's tables, however they lie in files."""
    return _one_hash({name: digest.digest(spark.read.schema(schema).parquet(f"{build}/{name}"))[0] for name, (_, schema) in TABLES.items()})


def _one_hash(digests: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(digests, sort_keys=True).encode()).hexdigest()


def install(spark: SparkSession, candidate: str, root: str, sha256: str | None = None) -> dict[str, int]:
    """Check a build folder (hash, schemas, keys) and publish its tables under root."""
    if sha256 and content_hash(spark, candidate) != sha256:
        raise ValueError("the candidate's hash differs")
    tables = {t: spark.read.schema(s).parquet(f"{candidate}/{t}") for t, (_, s) in TABLES.items()}
    keyed(tables)
    return publish(spark, tables, root)


def keyed(tables: dict[str, DataFrame]) -> None:
    """ValueError if a table holds a key twice."""
    for t, (keys, _) in TABLES.items():
        if not tables[t].groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"{t} holds a key twice")


def compact(answer: dict) -> str:
    """An answer on one line of JSON, non-ASCII kept."""
    return json.dumps(answer, ensure_ascii=False, separators=(",", ":"), default=str)


def release_doc(spark: SparkSession, root: str, tag: str, date: str) -> dict:
    """What a release says of itself: tag, date, schema version, rows of each table, source versions, and the build's hash."""
    found = pointer(spark, root)
    meta = spark.read.schema(TABLES["ingest_meta"][1]).parquet(f"{found['build']}/ingest_meta").filter(~F.startswith("source_name", F.lit("stig:")))
    versions = {r.source_name: r.source_version for r in meta.orderBy("source_name").collect()}
    return {"tag": tag, "date": date, "schema_version": found["schema_version"], "rows": found["rows"], "sources": versions, "digests": found["digests"], "sha256": _one_hash(found["digests"])}


def needs_release(before: dict | None, now: dict) -> tuple[bool, list[str]]:
    """(whether to release, notes): anything but tag and date differs from the last release; notes name changed sources and tables."""
    if before is None:
        return True, ["first release"]
    notes = [f"{k}: {before['sources'].get(k)} -> {now['sources'].get(k)}" for k in sorted({*before["sources"], *now["sources"]}) if before["sources"].get(k) != now["sources"].get(k)]
    notes += [f"{k}: {before['rows'].get(k, 0)} -> {n} rows" for k, n in now["rows"].items() if before["rows"].get(k, 0) != n]
    old, new = before.get("digests"), now.get("digests")
    if old is not None and new is not None:
        notes += [f"{k}: other content in {now['rows'][k]} rows" for k, h in new.items() if old.get(k) != h and before["rows"].get(k, 0) == now["rows"][k]]
    elif before.get("sha256") != now.get("sha256") and not notes:
        notes.append("content: another hash")  # a release from before tables had digests
    return bool(notes) or before["schema_version"] != now["schema_version"], notes


def report(findings: DataFrame) -> str:
    """A Markdown table of findings (finding, n), what is violated first; findings are a few named checks."""
    rows = findings.orderBy(F.desc("n"), "finding").collect()
    lines = [f"| {r.finding} | {r.n} | {'ok' if r.n == 0 else 'violated'} |" for r in rows]
    return "\n".join([f"{sum(r.n > 0 for r in rows)} of {len(rows)} checks are violated.", "", "| Check | Rows | State |", "| --- | --- | --- |", *lines])
