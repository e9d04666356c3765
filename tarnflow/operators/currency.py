"""What is installed against what is published: which release fits, what to do about it, and why. Installations are rows, so one plan answers
for one server or for a fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.functions import ids


def state(stored: Column, published: Column) -> Column:
    """newer, older or same, of what is published, by dotted numbers; texts that are none are the same or incomparable."""
    a, b = ids.dotted(stored), ids.dotted(published)
    told = F.when(b > a, "newer").when(b < a, "older").otherwise("same")
    return F.when(a.isNull() | b.isNull(), F.when(stored == published, "same").otherwise("incomparable")).otherwise(told)


def choices(releases: DataFrame, schemas: DataFrame, tag: str | None = None) -> DataFrame:
    """(schema, newest, beyond) for each asked schema: the newest release of it and the newest of a higher one, by date and then tag. With a
    tag only that release counts. releases: tag, date, schema and more; a tag of another schema than asked is `beyond` or nothing."""
    pool = releases if tag is None else releases.filter(F.col("tag") == tag)
    fields = [c for c in releases.columns if c not in ("date", "tag", "schema")]
    entry = F.struct("date", "tag", "schema", *fields)
    order = F.struct("date", "tag")
    best = pool.groupBy("schema").agg(F.max_by(entry, order).alias("newest"))
    every = schemas.select("schema").filter("schema is not null").distinct().join(best, "schema", "full")
    # One row a schema: schemas are numbered by hand, so they are few however many releases there are.
    above = Window.orderBy(F.desc("schema")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.max_by("newest", F.struct("newest.date", "newest.tag")).over(above)
    return every.withColumn("beyond", beyond).join(schemas.select("schema").distinct(), "schema", "left_semi")


def decisions(installed: DataFrame, releases: DataFrame, tag: str | None = None) -> DataFrame:
    """installed with `release` (that of the record, if the record is of this file), newest, beyond (tags), action and reason.

    installed: schema (what the software reads), sha256 (null: nothing usable), problem (why not, or null), recorded_sha256 and
    recorded_release (what an installation noted, or null), sources (map of its versions). releases: tag, date, schema, sha256, sources.
    Actions: install, upgrade_package (only a higher schema has something newer), build_locally (nothing is published and nothing is there),
    none. Tags hold their date, so they compare as texts.
    """
    chosen = choices(releases, installed, tag)
    own = F.when(F.col("sha256") == F.col("recorded_sha256"), F.col("recorded_release"))
    rows = installed.withColumn("release", own).join(chosen, "schema", "left")
    known = releases.select(F.col("tag").alias("release")).distinct().withColumn("_known", F.lit(True))
    rows = rows.join(known, "release", "left")
    stored, offered = F.coalesce("sources", F.create_map().cast("map<string,string>")), F.coalesce("newest.sources", F.create_map().cast("map<string,string>"))
    moved = lambda way: F.array_sort(F.filter(F.map_keys(offered), lambda k: F.coalesce(state(stored[k], offered[k]) == way, F.lit(False))))
    rows = rows.withColumn("_newer", moved("newer")).withColumn("_older", moved("older"))

    def made(action: str, *reason: Column | str) -> Column:
        return F.struct(F.lit(action).alias("action"), F.concat(*[F.lit(r) if isinstance(r, str) else r for r in reason]).alias("reason"))

    newest, beyond, at = F.col("newest.tag"), F.col("beyond.tag"), F.col("schema").cast("string")
    unusable = F.when(F.col("problem").isNull(), "nothing is installed").otherwise(F.concat(F.lit("what is installed can't be used: "), "problem"))
    absent = F.col("sha256").isNull()
    told = (
        F.when(newest.isNull() & beyond.isNotNull(), made("upgrade_package", "no release has schema ", at, "; ", beyond, " needs a newer package"))
        .when(newest.isNull() & absent, made("build_locally", unusable, ", and no release has schema ", at))
        .when(newest.isNull(), made("none", "no release has schema ", at, "; what is installed stays"))
        .when(absent, made("install", unusable))
        .when(F.col("sha256") == F.col("newest.sha256"), made("none", "the newest release is installed: ", newest))
        .when(F.col("release") < newest, made("install", newest, " is newer than ", F.col("release")))
        .when(F.col("release").isNotNull() & F.col("_known").isNull(), made("none", F.col("release"), " is installed and no longer published; the newest is ", newest))
        .when(F.col("release").isNotNull(), made("none", F.col("release"), " is current"))
        .when(F.size("_newer") == 0, made("none", "the local build is as current as ", newest))
        .otherwise(made("install", newest, " has newer ", F.array_join("_newer", ", "), F.when(F.size("_older") > 0, F.concat(F.lit("; older, and would replace: "), F.array_join("_older", ", "))).otherwise("")))
    )
    rows = rows.withColumn("_told", told)
    held = (F.col("_told.action") == "none") & beyond.isNotNull()
    action = F.when(held, "upgrade_package").otherwise(F.col("_told.action"))
    reason = F.when(held, F.concat("_told.reason", F.lit("; "), beyond, F.lit(" needs a newer package"))).otherwise(F.col("_told.reason"))
    return rows.select(*installed.columns, "release", newest.alias("newest"), beyond.alias("beyond"), action.alias("action"), reason.alias("reason"))
