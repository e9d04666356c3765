"""Joins, predicates and aggregations of the knowledge base, over any tables: DataFrames and column names in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from tarnflow.operators import segments


def bridge_findings(category: DataFrame, bridge: DataFrame, finding: DataFrame, *, category_key: str, bridge_key: str, finding_key: str, name: str, within: str, scope: DataFrame) -> DataFrame:
    """The three-hop bridge join: one row for each finding that the category `within` reaches, and the narrower categories it came by.

    A category named `within` followed by '(' (or, for other naming schemes, any longer name that starts with it) rolls up to it. cites says
    that the category itself reached the finding; via is then empty, else the sorted names of the narrower ones. scope holds the allowed
    combinations of its own columns, a semi-join on all of them: a small table that Spark broadcasts by its size.
    """
    near = category.filter(F.col(name).startswith(within)).select(category_key, name)
    found = bridge.select(category_key, bridge_key).join(near, category_key).join(finding, F.col(bridge_key) == F.col(finding_key)).join(scope, scope.columns, "left_semi")
    keys = finding.columns
    grouped = found.groupBy(*keys).agg(F.max(F.col(name) == within).alias("cites"), F.sort_array(F.collect_set(F.when(F.col(name) != within, F.col(name)))).alias("via"))
    return grouped.withColumn("via", F.when(F.col("cites"), F.array().cast("array<string>")).otherwise(F.col("via")))


def precedence(df: DataFrame, keys: list[str], source: str, strong: str, weak: str) -> DataFrame:
    """One row for each key: strong if any of its rows has that source, else weak."""
    return df.groupBy(*keys).agg(F.max(F.when(F.col(source) == strong, 1).otherwise(0)).alias("_s")).select(*keys, F.when(F.col("_s") == 1, strong).otherwise(weak).alias("source"))


def children(df: DataFrame, parent: str, child: Column, name: str) -> DataFrame:
    return df.groupBy(parent).agg(F.sort_array(F.collect_set(child)).alias(name))


def redirected(requests: DataFrame, live: DataFrame, redirects: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Every request with the live row that answers it: its own, else its redirect's, with redirected_from set; else nulls."""
    direct = requests.join(live.withColumn("_live", F.lit(True)), key, "left")
    hit = direct.filter("_live").drop("_live").withColumn("redirected_from", F.lit(None).cast(requests.schema[key].dataType)).withColumnRenamed(key, "answer").withColumn(key, F.col("answer"))
    missed = direct.filter("_live is null").select(key)
    moved = missed.join(redirects.select(F.col(old).alias(key), F.col(new).alias("answer")), key, "left")
    moved = moved.join(live.withColumnRenamed(key, "answer"), "answer", "left").withColumn("redirected_from", F.when(F.col("answer").isNotNull(), F.col(key)))
    return hit.unionByName(moved)


def folded_lookup(df: DataFrame, columns: list[str], wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows one of whose columns equals a wanted id, cases and outer spaces aside; each row once."""
    ids = wanted.select(F.upper(F.trim(wanted_key)).alias("_id")).distinct()
    tagged = df.withColumn("_id", F.explode(F.array_distinct(F.array(*[F.upper(c) for c in columns]))))
    return tagged.join(ids, "_id", "left_semi").drop("_id").distinct()


def not_found(wanted: DataFrame, wanted_key: str, found: DataFrame, columns: list[str]) -> DataFrame:
    ids = found.select(F.explode(F.array(*[F.upper(c) for c in columns])).alias("_id")).distinct()
    return wanted.withColumn("_id", F.upper(F.trim(wanted_key))).join(ids, "_id", "left_anti").drop("_id")


def divided(parents: DataFrame, parent: str, items: DataFrame, item: str, allowed: list[str] | None) -> DataFrame:
    """parents with `holds`: true where a parent has items and all of them are allowed; null everywhere if nothing was asked."""
    if allowed is None:
        return parents.withColumn("holds", F.lit(None).cast("boolean"))
    judged = items.groupBy(parent).agg(F.bool_and(F.col(item).isin(allowed)).alias("_all"))
    return parents.join(judged, parent, "left").withColumn("holds", F.coalesce("_all", F.lit(False))).drop("_all")


def overlaps(df: DataFrame, items: str, wanted: list[str] | None) -> DataFrame:
    """df with `applies`: whether the array holds a wanted item; null if nothing was asked."""
    if wanted is None:
        return df.withColumn("applies", F.lit(None).cast("boolean"))
    return df.withColumn("applies", F.arrays_overlap(F.col(items), F.array(*[F.lit(w) for w in wanted])))


def orphans(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return df.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_anti")


def without_orphans(df: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    return df.join(known.select(F.col(known_key).alias(key)).distinct(), key, "left_semi")


def completed(dimension: DataFrame, key: str, referenced: DataFrame, referenced_key: str, made: dict[str, Column]) -> DataFrame:
    """dimension with a row, of made's columns, for every referenced key that it lacks."""
    missing = orphans(referenced.select(F.col(referenced_key).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, dimension, key)
    return dimension.unionByName(missing.select(key, *[c.alias(n) for n, c in made.items()]), allowMissingColumns=True)


def parent_repaired(df: DataFrame, key: str, parent: str) -> DataFrame:
    """df with parents that aren't rows of df set to null."""
    known = df.select(F.col(key).alias(parent)).distinct().withColumn("_known", F.lit(True))
    return df.join(known, parent, "left").withColumn(parent, F.when(F.col("_known"), F.col(parent))).select(*df.columns)


def thresholds(df: DataFrame, by: str, steps: list[tuple[int, str | None]]) -> DataFrame:
    """df with `governed` and `version`: the version of the highest minimum that the value reaches. A few fixed steps, so no join."""
    version, governed = F.lit(None).cast("string"), F.lit(False)
    for least, name in sorted(steps, key=lambda s: s[0]):
        version = F.when(F.col(by) >= least, F.lit(name)).otherwise(version)
        governed = F.when(F.col(by) >= least, F.lit(True)).otherwise(governed)
    return df.withColumn("governed", governed).withColumn("version", version)


def range_lookup(df: DataFrame, key: str, by: str, table: DataFrame, least: str, value: str) -> DataFrame:
    """df with `value` of the table's row of the same key with the highest `least` up to df's `by`: an as-of join without a range join.

    Both sides are put in order together, by key and value, and the last table row before a row answers. A key may span many tasks.
    """
    held = StructType([StructField("v", table.schema[value].dataType)])
    left = df.withColumn("_at", F.col(by)).withColumn("_side", F.lit(1)).withColumn("_row", F.lit(None).cast(held))
    right = table.select(key, F.col(least).alias("_at"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).cast(held).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    found = segments.running(both, [key], [F.asc("_at"), F.asc("_side")], F.col("_row"), "_last", "last")
    return found.filter("_side = 1").select(*df.columns, F.col("_last.v").alias(value))


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern is found in c, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def alias_hits(rows: DataFrame, key: str, tokens: str, aliases: list[tuple[str, int, list[str]]]) -> DataFrame:
    """(key, alias, position) of the first alias of each name whose required tokens are all among the row's. aliases: name, position, tokens."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(n, p, t) for n, p, t in aliases if t], "alias string, position int, required array<string>")
    # One equi-join on each alias's rarest-looking (longest) token, then the subset test: no row meets an alias without a common token.
    anchored = table.withColumn("anchor", F.reduce("required", F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a)))
    met = rows.select(key, tokens, F.explode(F.array_distinct(F.col(tokens))).alias("anchor")).join(F.broadcast(anchored), "anchor")  # the list's size; Spark would send the rows, which it takes for smaller
    hits = met.filter(F.size(F.array_except("required", tokens)) == 0)
    return hits.groupBy(key, "alias").agg(F.min("position").alias("position"))


def coverage(df: DataFrame, has_mitigation: str, has_rules: str, applicable: str, detectable: str) -> DataFrame:
    """df with gap flags: without_mitigation, else mitigated_without_rules; and one detection class, judged by applicability first."""
    without = ~F.col(has_mitigation)
    detect = F.when(~F.col(applicable), "without_applicable_analytic").when(F.col(detectable), "detectable").otherwise("undetectable")
    return df.withColumn("mitigation_gap", F.when(without, "without_mitigation").when(~F.col(has_rules), "mitigated_without_rules")).withColumn("detect_class", detect)


def summary(df: DataFrame, cat: str, display: Column, top: str) -> DataFrame:
    """One row: total, a count for each category, and the number of distinct display ids in the top one."""
    counts = df.groupBy(cat).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col(cat) == top, display)).alias("d"))
    return counts.agg(F.sum("n").alias("total"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", F.col(cat), F.col("n").cast("string")))), ",").alias("by_cat"), F.sum("d").alias("top_ids"))


def distinctive_band(frequencies: DataFrame, df_column: str, gate: Column, width: int) -> DataFrame:
    """Tokens just within and just beyond the gate: (gate - width, gate] and (gate, gate + width]."""
    d = F.col(df_column)
    side = F.when((d > gate - width) & (d <= gate), "within").when((d > gate) & (d <= gate + width), "beyond")
    return frequencies.withColumn("side", side).filter(F.col("side").isNotNull())
