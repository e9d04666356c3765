"""First-wins, newest-wins and top-k operators. Ties always go by a stated column, never by where a row happens to lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.operators import segments

EPSILON = 1e-9


def winners(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order. Spark keeps one row a key before it shuffles (WindowGroupLimit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def contest(df: DataFrame, keys: list[str], *, major: str, release: str, is_library: str, status_date: str, artifact: str, arrival: str) -> DataFrame:
    """The newest release of each key: by major and release, library first, newest status date (none counts as oldest), artifact, then the
    earliest arrival."""
    order = [F.desc(major), F.desc(release), F.desc(is_library), F.desc(F.coalesce(F.col(status_date).cast("string"), F.lit(""))), F.desc(artifact), F.asc(arrival)]
    return winners(df, keys, order)


def departures(df: DataFrame, keys: list[str], rank: Column, is_library: str, arrival: str) -> DataFrame:
    """Losers of a contest, binned against who led when they fell: one that arrives and loses falls to the leader then; a leader that is
    overtaken falls to who overtakes it. (keys, superseded_by_library, superseded_same_key)"""
    entry = F.struct(rank.alias("r"), (-F.col(arrival)).alias("a"), F.col(is_library).alias("lib"))
    led = segments.running(df.withColumn("_own", entry), keys, [F.asc(arrival)], F.col("_own"), "_lead", "max", inclusive=False)
    fell = led.filter("_lead is not null").withColumn("_by", F.when(F.col("_own") > F.col("_lead"), F.col("_own.lib")).otherwise(F.col("_lead.lib"))).withColumn("_who", F.when(F.col("_own") > F.col("_lead"), F.col("_lead.lib")).otherwise(F.col("_own.lib")))
    by_library = F.col("_by") & ~F.col("_who")
    return fell.groupBy(*keys).agg(F.count_if(by_library).alias("superseded_by_library"), F.count_if(~by_library).alias("superseded_same_key"))


def lifecycle(df: DataFrame, key: str, *, major: str, is_library: str) -> DataFrame:
    """Rows that stay: the library's; keys and majors that the library offers too; others above the library's highest major, or, where it
    offers none, at the highest one. Keys compare without case. A row offered by the library at its key and major stays too."""
    folded = F.lower(F.col(key))
    w = Window.partitionBy(folded)
    tagged = df.withColumn("_lib", F.max(F.when(F.col(is_library), F.col(major))).over(w)).withColumn("_own", F.max(F.when(~F.col(is_library), F.col(major))).over(w))
    offered = F.max(F.col(is_library)).over(Window.partitionBy(folded, F.col(major)))
    keep = F.col(is_library) | F.col("_offered") | F.when(F.col("_lib").isNotNull(), F.col(major) > F.col("_lib")).otherwise(F.col(major) == F.col("_own"))
    return tagged.withColumn("_offered", offered).filter(keep).drop("_lib", "_own", "_offered")


def claims(df: DataFrame, item: str, order: list[Column], holder: list[str]) -> DataFrame:
    """Every row with `held`: whether it is the first claim of its item; rows carry the holder's columns as holder_<name>."""
    return segments.firsts(df, [item], order, holder)


def top_holders(losers: DataFrame, loser: str, holder: str, most: int = 3) -> DataFrame:
    """For each loser its holders by lost items, then by name: the first `most`, and how many more there are."""
    counted = losers.groupBy(loser, holder).agg(F.count("*").alias("lost"))
    w = Window.partitionBy(loser).orderBy(F.desc("lost"), holder)
    ranked = counted.withColumn("place", F.row_number().over(w)).withColumn("holders", F.count("*").over(Window.partitionBy(loser)))
    return ranked.filter(F.col("place") <= most).withColumn("more", F.greatest(F.col("holders") - most, F.lit(0))).drop("holders")


def best_hits(df: DataFrame, key: str, score: str, origin: str) -> DataFrame:
    """The best hit of each key: by score, then directly found before redirected, then the lowest origin."""
    return winners(df, [key], [F.desc(score), F.col(origin).asc_nulls_first()])


def top_groups(df: DataFrame, key: str, order: list[tuple[str, bool]], most: int) -> DataFrame:
    """All rows of the first `most` keys, ranked by each key's best row. order: (column, descending); the key comes last.

    Keys are first reduced to their best row; `most` of them are then taken by a top-k, so no window holds the table."""
    by = [F.desc(c) if down else F.asc(c) for c, down in order]
    best = winners(df, [key], by).select(key, *[c for c, _ in order if c != key])
    kept = best.orderBy(*by, key).limit(most).select(key)
    return df.join(kept, key, "left_semi")


def tied_omitted(df: DataFrame, key: str, score: str, most: int) -> DataFrame:
    """One row: how many keys beyond the first `most` score as well as the last one kept."""
    best = df.groupBy(key).agg(F.max(score).alias("_s"))
    cut = best.orderBy(F.desc("_s"), key).limit(most).agg(F.min("_s").alias("_cut"), F.count("*").alias("_kept"))
    level = best.join(F.broadcast(cut), F.abs(F.col("_s") - F.col("_cut")) <= EPSILON)  # cut is one row
    kept = best.orderBy(F.desc("_s"), key).limit(most)
    kept_level = kept.join(F.broadcast(cut), F.abs(F.col("_s") - F.col("_cut")) <= EPSILON)
    return level.agg(F.count("*").alias("_all")).crossJoin(kept_level.agg(F.count("*").alias("_in"))).select((F.col("_all") - F.col("_in")).alias("tied_omitted"))  # one row each
