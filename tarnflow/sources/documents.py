"""Readers of single documents: benchmarks, the CCI list, the ATT&CK bundle, the control catalog, mappings and overrides.

Every reader has a schema of its own; nothing is inferred. XML with a document type declaration is refused as unreadable.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import ids

_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "inferSchema": "false", "attributePrefix": "_", "valueTag": "_VALUE"}
_TEXT = "struct<_VALUE:string>"
_RULE = "struct<_id:string,_severity:string,title:string,description:string,fixtext:struct<_VALUE:string>,check:array<struct<`check-content`:string>>,ident:array<struct<_system:string,_VALUE:string>>>"
BENCHMARK = f"_id string, title string, version string, status array<struct<_date:string,_VALUE:string>>, `plain-text` array<struct<_id:string,_VALUE:string>>, Group array<struct<_id:string,Rule:array<{_RULE}>>>, _corrupt_record string"


def safe_xml(content: Column) -> Column:
    return F.when(~F.contains(F.lower(content), F.lit("<!doctype")), content)


def root_tag(content: Column) -> Column:
    """The local name of an XML text's root element, or null."""
    bare = F.regexp_replace(F.regexp_replace(content, r"(?s)<\?.*?\?>", ""), r"(?s)<!--.*?-->", "")
    return ids.group(bare, r"\A\s*<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)")


def benchmarks(files: DataFrame) -> DataFrame:
    """files (path, content text, other columns) with what each benchmark says of itself, and `rules`; unreadable ones have a null stig_id.

    status is the first one; release_info the last plain text with that id.
    """
    x = F.from_xml(safe_xml(F.col("content")), BENCHMARK, _XML)
    # The generator keeps the optimizer from parsing the document again for each column that reads of it.
    parsed = files.select("*", F.explode(F.array(F.when(root_tag(F.col("content")) == "Benchmark", x))).alias("x")).withColumn("x", F.when(F.col("x._corrupt_record").isNull(), F.col("x")))
    info = F.filter(F.col("x").getField("plain-text"), lambda p: p["_id"] == "release-info")
    return parsed.select(
        *[c for c in files.columns if c != "content"],
        F.col("x._id").alias("stig_id"), F.trim("x.title").alias("title"), F.coalesce(F.trim("x.version"), F.lit("")).alias("version"),
        F.trim(F.get(F.col("x.status"), 0)["_VALUE"]).alias("status"), F.get(F.col("x.status"), 0)["_date"].alias("status_date"),
        F.coalesce(F.trim(F.try_element_at(info, F.lit(-1))["_VALUE"]), F.lit("")).alias("release_info"), F.col("x.Group").alias("groups"),
    )


def rules(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """The rules of parsed benchmarks, in document order (group_pos, rule_pos). A rule without a severity is `rejected`."""
    groups = parsed.select(*keep, F.posexplode("groups").alias("group_pos", "g"))
    each = groups.select(*keep, "group_pos", F.col("g._id").alias("group_id"), F.posexplode("g.Rule").alias("rule_pos", "r"))
    level = F.col("r._severity")
    ccis = F.filter(F.transform(F.coalesce(F.col("r.ident"), F.array()), lambda i: i["_VALUE"]), lambda v: v.startswith("CCI-"))
    rows = each.select(
        *keep, "group_pos", "rule_pos", "group_id", F.col("r._id").alias("rule_id"), level.alias("severity_level"), ids.severity_cat(level).alias("severity_cat"),
        F.trim("r.title").alias("title"), F.trim("r.description").alias("discussion"), F.trim("r.fixtext._VALUE").alias("fix_text"),
        F.trim(F.get(F.col("r.check"), 0)["check-content"]).alias("check_text"), F.array_distinct(F.transform(ccis, lambda v: F.trim(v))).alias("ccis"),
    )
    return rows.withColumn("rejected", F.col("severity_level").isNull())


def cci_list(spark: SparkSession, path: str) -> DataFrame:
    """(cci_id, definition, controls): controls are those of Revision 5, each once, in order. A list without items is an error."""
    schema = "_id string, definition string, references struct<reference:array<struct<_creator:string,_title:string,_version:string,_index:string>>>"
    rows = spark.read.format("xml").options(rowTag="cci_item", **{k: v for k, v in _XML.items()}).schema(schema).load(path).filter("_id is not null")
    if rows.isEmpty():
        raise ValueError(f"no cci_item in {path}")
    fifth = F.filter(F.coalesce(F.col("references.reference"), F.array()), lambda r: F.coalesce(F.contains(r["_title"], F.lit("Revision 5")), F.lit(False)) | F.coalesce(r["_version"] == "5", F.lit(False)))
    controls = F.array_distinct(F.filter(F.transform(fifth, lambda r: ids.control_id(r["_index"])), lambda c: c.isNotNull()))
    return rows.select(F.trim("_id").alias("cci_id"), F.trim("definition").alias("definition"), controls.alias("controls"))


def cci_list_version(spark: SparkSession, path: str) -> str | None:
    """The version that the list's metadata names, or null."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(ids.group(F.col("value"), r"(?s)<metadata>.*?<version>\s*([^<]*?)\s*</version>")).first()[0]


_REF = "array<struct<source_name:string,external_id:string>>"
BUNDLE = (
    "objects array<struct<type:string,id:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,x_mitre_version:string,x_mitre_attack_spec_version:string,created:string,"
    f"external_references:{_REF},kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>,x_mitre_is_subtechnique:boolean,aliases:array<string>,"
    "x_mitre_analytic_refs:array<string>,x_mitre_platforms:array<string>,x_mitre_log_source_references:array<struct<name:string,channel:string,x_mitre_data_component_ref:string>>,"
    "x_mitre_mutable_elements:array<map<string,string>>,relationship_type:string,source_ref:string,target_ref:string>>"
)


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """One row for each object, with its place in the file, its external id and whether it is live."""
    return _objects(spark.read.schema(BUNDLE).option("multiLine", True).json(path))


def bundles(texts: DataFrame, content: str) -> DataFrame:
    """bundle() of bundles that are texts in a column; places are those in each text. A text that is no bundle has no objects."""
    # The generator keeps the optimizer from parsing the text again for each column that is read of it.
    return _objects(texts.select(F.explode(F.array(F.from_json(content, BUNDLE))).alias("b")).select("b.objects"))


def _objects(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.posexplode("objects").alias("pos", "o")).select("pos", "o.*")
    refs = F.filter(F.coalesce(F.col("external_references"), F.array()), lambda r: r["source_name"] == "mitre-attack")
    live = ~F.coalesce(F.col("revoked"), F.lit(False)) & ~F.coalesce(F.col("x_mitre_deprecated"), F.lit(False))
    return rows.withColumn("attack_id", F.get(refs, 0)["external_id"]).withColumn("live", live)


def control_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(control_id, name, family, is_enhancement, parent_control_id); ids that can't be read are left out, and what is under them."""
    inner = "struct<id:string,title:string>"
    schema = f"catalog struct<metadata:struct<version:string>,groups:array<struct<id:string,title:string,controls:array<struct<id:string,title:string,controls:array<{inner}>>>>>>"
    groups = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("catalog.groups").alias("g"))
    base = groups.select(F.upper("g.id").alias("family"), F.explode("g.controls").alias("c")).withColumn("control_id", ids.catalog_control_id(F.col("c.id"))).filter("control_id is not null")
    more = base.select("family", F.col("control_id").alias("parent"), F.explode("c.controls").alias("e"))
    top = base.select("control_id", F.col("c.title").alias("name"), "family", F.lit(False).alias("is_enhancement"), F.lit(None).cast("string").alias("parent_control_id"))
    under = more.select(ids.catalog_control_id(F.col("e.id")).alias("control_id"), F.col("e.title").alias("name"), "family", F.lit(True).alias("is_enhancement"), F.col("parent").alias("parent_control_id"))
    return top.unionByName(under.filter("control_id is not null"))


def catalog_version(spark: SparkSession, path: str) -> str | None:
    rows = spark.read.schema("catalog struct<metadata:struct<version:string>>").option("multiLine", True).json(path)
    return rows.select(F.nullif(F.trim("catalog.metadata.version"), F.lit(""))).first()[0]


def mappings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(pairs, reviewed technique ids without a mapping, version label), by the file's suffix: .csv or .json."""
    if path.lower().endswith(".csv"):
        rows = spark.read.schema("technique_id string, control_id string").option("header", True).csv(path)
        pairs = rows.select(F.trim("technique_id").alias("technique_id"), ids.control_id(F.col("control_id")).alias("control_id")).filter("technique_id <> '' and control_id is not null")
        return pairs, pairs.select("technique_id").limit(0), "csv"
    schema = "metadata struct<mapping_version:string,mapping_framework_version:string,attack_version:string,last_update:string>, mapping_objects array<struct<attack_object_id:string,capability_id:string,mapping_type:string,status:string>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("mapping_objects").alias("pos", "m")).select("pos", "m.*")
    pairs = rows.filter("mapping_type = 'mitigates' and coalesce(status, '') <> 'non_mappable'").select(F.col("attack_object_id").alias("technique_id"), ids.control_id(F.col("capability_id")).alias("control_id"))
    reviewed = rows.filter("status = 'non_mappable'").select(F.col("attack_object_id").alias("technique_id")).distinct()
    label = doc.select(ids.mapping_version(*[F.col(f"metadata.{c}") for c in ("mapping_version", "mapping_framework_version", "attack_version", "last_update")])).first()[0]
    return pairs.filter("control_id is not null").distinct(), reviewed, label


def mapping_framework(spark: SparkSession, path: str) -> str | None:
    """The release of the technique data that a JSON mapping was made for, or null; CSV files don't say."""
    if path.lower().endswith(".csv"):
        return None
    rows = spark.read.schema("metadata struct<attack_version:string>").option("multiLine", True).json(path)
    return rows.select(F.nullif(F.trim("metadata.attack_version"), F.lit(""))).first()[0]


def overrides(spark: SparkSession, path: str | None, named: bool = False) -> tuple[DataFrame, DataFrame]:
    """(added pairs, suppressed pairs) of a small YAML file. Without the file both are empty, unless it was named: then it's an error."""
    found = {}
    if path and Path(path).exists():
        found = _yaml_pairs(Path(path).read_text())
    elif named:
        raise FileNotFoundError(f"the override file {path} was named and isn't there")
    schema = "technique_id string, control_id string"
    return tuple(spark.createDataFrame([(e["technique"], e["control"]) for e in found.get(k) or []], schema) for k in ("add", "suppress"))


def _yaml_pairs(text: str) -> dict:
    """Lists of flat mappings under top-level keys: all that an override file holds."""
    try:
        import yaml

        return yaml.safe_load(text) or {}
    except ImportError:
        pass
    import re

    out: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split("#")[0].rstrip()
        if m := re.fullmatch(r"(\w+):\s*(\[\])?", line):
            key = m[1]
            out[key] = []
        elif key and (pairs := re.findall(r"(\w+):\s*[\"']?([^\"',}\s]+)", line)):
            if line.lstrip().startswith("-"):
                out[key].append({})
            out[key][-1].update(pairs)
    return out
