"""Files and archives: an inventory by name and root element, benchmarks out of zips and zips of zips (nested.py), hashes, published listings."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.functions import ids
from tarnflow.sources import nested
from tarnflow.sources.documents import root_tag


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, length, content) of every file directly in the folder; content is read of XML files alone, as archives may be of any size.
    A name with a part cui_ is an error."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    texts = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(folder).select("path", "content")
    rows = files.join(texts, "path", "left").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")
    guard = F.when(ids.holds_barred_part(F.col("name")), F.raise_error(F.concat(F.lit("controlled content is out of scope: "), F.col("name"))).cast("string")).otherwise(F.col("name"))
    return rows.withColumn("name", guard)


def classified(files: DataFrame) -> DataFrame:
    """files with `kind`: library, sunset, product_zip, loose, or null. Names decide first; other XML is loose if its root is a Benchmark."""
    low = F.lower("name")
    kind = (
        F.when(low.rlike(r"^u_srg-stig_library.*\.zip$"), "library")
        .when(low.rlike(r"sunset_compilation.*\.zip$"), "sunset")
        .when(low.endswith(".zip"), "product_zip")
        .when(low.rlike(r"xccdf\.xml$"), "loose")
        .when(low.endswith(".xml") & (root_tag(F.decode("content", "UTF-8")) == "Benchmark"), "loose")
    )
    return files.withColumn("kind", kind)


def one_library(inventory: DataFrame) -> str | None:
    """The library's name, or None; an error if there are two: which one is meant can't be told."""
    names = [r["name"] for r in inventory.filter("kind = 'library'").select("name").limit(10).collect()]
    if len(names) > 1:
        raise ValueError(f"more than one library: {sorted(names)}")
    return names[0] if names else None


def source_status(inventory: DataFrame) -> DataFrame:
    """Which classes of source are there."""
    kinds = ("library", "sunset", "product_zip", "loose")
    return inventory.agg(*[F.coalesce(F.max(F.col("kind") == k), F.lit(False)).alias(k) for k in kinds])


def source_files(files: DataFrame) -> DataFrame:
    """(name, sha256, size); a name that is there twice is an error."""
    twice = F.when(F.count("*").over(Window.partitionBy("name")) > 1, F.raise_error(F.concat(F.lit("two files named "), F.col("name"))).cast("string")).otherwise(F.col("name"))
    return nested.hashed(files.select("path", "name", F.col("length").alias("size"))).select(twice.alias("name"), "sha256", "size")


def benchmark_documents(inventory: DataFrame, range_bytes: int = nested.RANGE_BYTES) -> DataFrame:
    """Every benchmark of an inventory (kind, name, path, length) with where it came from; a damaged archive or member is a row with `problem`.
    Archives are read by ranges, each by a task of its own."""
    return nested.read_documents(inventory.sparkSession, inventory, range_bytes)


def extracted(documents: DataFrame) -> DataFrame:
    """Loose copies to write: same basename and content once; same basename and other content numbered 2_, 3_ in order of path."""
    rows = documents.filter("content is not null").select("source_document", F.element_at(F.split("source_document", "/"), -1).alias("base"), F.sha2("content", 256).alias("sha256"), "content")
    first = rows.groupBy("base", "sha256").agg(F.min("source_document").alias("source_document"), F.first("content").alias("content"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("source_document", "sha256"))
    return first.withColumn("n", n).select(F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit("_"), F.col("base"))).otherwise(F.col("base")).alias("name"), "sha256", "content")


# --- published listings


def published_zips(spark: SparkSession, path: str, base: str, zip_path: str) -> tuple[DataFrame, DataFrame]:
    """(name, date of each zip under base or a mirror of zip_path; links off it). The newest date of a name holds. A name with a path in it
    refuses the whole listing."""
    schema = "returnValue array<struct<DownloadLink:string,UploadDate:string,FileName:string,DownloadType:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("returnValue").alias("pos", "r")).select("pos", F.col("r.DownloadLink").alias("link"), F.coalesce("r.UploadDate", F.lit("")).alias("date"))
    zips = rows.filter(F.lower("link").endswith(".zip")).withColumn("plain", F.regexp_replace("link", "(?<!:)/{2,}", "/"))
    after = F.when(F.startswith("plain", F.lit(base)), F.substring(F.col("plain"), len(base) + 1, 4096)).when(F.instr(F.col("plain"), zip_path) > 0, F.substring_index("plain", zip_path, -1))
    named = zips.withColumn("quoted", after)
    name = F.try_url_decode(F.replace("quoted", F.lit("+"), F.lit("%2B")))
    checked = F.when(F.col("quoted").isNull() | ids.is_bare_name(name), name).otherwise(F.raise_error(F.concat(F.lit("not a plain file name: "), name)).cast("string"))
    kept = named.filter("quoted is not null").select("pos", "date", checked.alias("name"))
    newest = kept.groupBy("name").agg(F.max("date").alias("date"))
    return newest, named.filter("quoted is null").select("link")


def newest_per_product(zips: DataFrame) -> DataFrame:
    """The newest release of each product in each scheme, and all names without a release."""
    rows = zips.filter(ids.archive_tier(F.col("name")) == "benchmark").withColumn("r", ids.release_of(F.col("name")))
    best = rows.filter("r is not null").groupBy("r.product", "r.scheme").agg(F.max_by("name", F.struct("r.a", "r.b")).alias("name"))
    return best.select("name").unionByName(rows.filter("r is null").select("name"))


def newest_library(zips: DataFrame) -> str:
    """The library with the latest (year, month); an error without one or if no name can be read."""
    rows = zips.filter((ids.archive_tier(F.col("name")) == "compilation") & ~ids.is_sunset(F.col("name")))
    top = rows.agg(F.max(F.struct(ids.library_order(F.col("name")).alias("o"), "name")).alias("t")).first().t
    if top is None or (top.o.year, top.o.month) == (0, 0):
        raise ValueError("no library whose release can be read")
    return top["name"]


def latest_attack(spark: SparkSession, path: str) -> tuple[str, dict[str, str]]:
    """(latest version, version -> date) of the ATT&CK index."""
    schema = "collections array<struct<name:string,versions:array<struct<version:string,modified:string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("collections").alias("c")).filter("c.name = 'Enterprise ATT&CK'").select(F.explode("c.versions").alias("v")).select("v.*")
    known = rows.withColumn("key", ids.version_pair(F.col("version"))).filter("key is not null")
    best = known.agg(F.max_by("version", "key").alias("v"), F.map_from_entries(F.collect_list(F.struct("version", ids.date_part(F.col("modified"))))).alias("d")).first()
    return best.v, best.d or {}


def release_dates(spark: SparkSession, path: str | None) -> dict[str, str]:
    """Version -> date of the ATT&CK index; empty where there is none or it can't be read, as dates only make notes more exact."""
    try:
        return latest_attack(spark, path)[1] if path else {}
    except (AnalysisException, SparkRuntimeException):
        return {}


def latest_folder(spark: SparkSession, path: str) -> tuple[str, str]:
    """(version, folder name) of the highest attack-MAJOR.MINOR folder of a listing. Names of other forms are passed over, since the name goes
    into a URL; none at all is an error."""
    rows = spark.read.schema("name string, type string").option("multiLine", True).json(path)
    version = ids.group(F.col("name"), r"\Aattack-([0-9]+\.[0-9]+)\z")
    found = rows.filter("type = 'dir'").withColumn("version", version).filter("version is not null")
    best = found.agg(F.max_by(F.struct("version", "name"), ids.version_pair(F.col("version"))).alias("b")).first().b
    if best is None:
        raise ValueError(f"{path} lists no folder attack-MAJOR.MINOR")
    return best.version, best["name"]


def listed_blob(spark: SparkSession, path: str, name: str) -> str:
    """The git blob id of a file in a listing; an error if the listing hasn't the file, or what it gives is no such id."""
    rows = spark.read.schema("name string, type string, sha string").option("multiLine", True).json(path)
    row = rows.filter((F.col("type") == "file") & (F.col("name") == name)).select("sha").first()
    if row is None:
        raise ValueError(f"{path} lists no file {name}")
    if not re.fullmatch("[0-9a-f]{40}", row.sha or ""):
        raise ValueError(f"{path} gives {row.sha!r} for {name}, which is no blob id")
    return row.sha


def releases(spark: SparkSession, path: str, tag: str, downloads: str | None = None) -> DataFrame:
    """(tag, date, name, url) of releases that aren't drafts or prereleases, whose tag starts with `tag` and that hold one dated asset. With
    downloads, the prefix of the repository's own download URLs, an asset of such a release at any URL but prefix, tag and name refuses all."""
    schema = "tag_name string, draft boolean, prerelease boolean, assets array<struct<name:string,browser_download_url:string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = rows.filter(~F.coalesce("draft", F.lit(False)) & ~F.coalesce("prerelease", F.lit(False)) & F.startswith("tag_name", F.lit(tag)))
    if downloads:
        plain = F.filter("assets", lambda a: ids.is_bare_name(a["name"]))  # other names are never asked for
        strange = F.get(F.filter(plain, lambda a: ~a["browser_download_url"].eqNullSafe(F.concat(F.lit(downloads), F.col("tag_name"), F.lit("/"), a["name"]))), 0)
        refused = F.raise_error(F.concat(F.lit("a release lists "), strange["name"], F.lit(" at "), F.coalesce(strange["browser_download_url"], F.lit("no URL")))).cast("string")
        rows = rows.withColumn("assets", plain).withColumn("tag_name", F.when(strange.isNull(), F.col("tag_name")).otherwise(refused))
    dated = F.filter("assets", lambda a: a["name"].rlike(r"[0-9]{4}-[0-9]{2}-[0-9]{2}.*\.(?:xz|zip|zst)$"))
    # A barrier, since a filter moved below the check would pass a strange asset over.
    kept = rows.select(F.explode(F.array(F.struct("tag_name", dated.alias("a")))).alias("r")).select("r.*").filter("tag_name is not null and size(a) = 1")
    one = F.get("a", 0)
    return kept.select("tag_name", ids.group(one["name"], "([0-9]{4}-[0-9]{2}-[0-9]{2})").alias("date"), one["name"].alias("name"), one["browser_download_url"].alias("url"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of a checksum file; one line of another form refuses all."""
    form = r"^([0-9a-f]{64})  (\S.*)$"
    rows = spark.read.text(path).filter("value <> ''")
    checked = F.when(F.col("value").rlike(form), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a checksum line: "), F.col("value"))).cast("string"))
    return rows.select(F.regexp_extract(checked, form, 2).alias("name"), F.regexp_extract(checked, form, 1).alias("sha256"))


def notices(files: DataFrame) -> DataFrame:
    """(name, text) of licence and notice files of a listing."""
    named = F.lower("name").rlike(r"^(?:license|licence|notice|copying)")
    return files.filter(named).select("name", F.decode("content", "UTF-8").alias("text"))
