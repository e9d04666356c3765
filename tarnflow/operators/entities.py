"""Names matched to entities: exact labels, loose keys, and suggestions by sequence similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIMILAR, MOST, LONGEST = 0.75, 5, 100


def _folded(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold().strip())


def folded(c: str | Column) -> Column:
    """NFKC and case folding, which Spark has no function for."""
    return F.pandas_udf(_folded, "string")(c)


def loose_key(label: Column) -> Column:
    """The folded label's letters and digits, without a last word group or team."""
    words = F.trim(F.regexp_replace(label, r"[^\p{L}\p{N}]+", " "))
    return F.replace(F.regexp_replace(words, " (?:group|team)$", ""), F.lit(" "), F.lit(""))


def matched(labels: DataFrame, typed: DataFrame) -> DataFrame:
    """(typed, id, tier) of the best tier for each typed name: 1 an id or name, 2 an alias, 3 a loose key. Several ids mean that it is
    ambiguous; no row means no match. labels: id, label, tier (1 or 2)."""
    own = labels.select("id", "tier", folded("label").alias("f"))
    asked = typed.select("typed", folded("typed").alias("f")).filter("f <> ''")
    exact = asked.join(own, "f").select("typed", "id", "tier")
    loose = asked.withColumn("l", loose_key(F.col("f"))).filter("l <> ''").join(own.select("id", loose_key(F.col("f")).alias("l")), "l").select("typed", "id", F.lit(3).alias("tier"))
    best = exact.unionByName(loose).groupBy("typed", "id").agg(F.min("tier").alias("tier"))
    return best.withColumn("_b", F.min("tier").over(Window.partitionBy("typed"))).filter("tier = _b").drop("_b")


def _closeness(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    def forms(x: str) -> set[str]:
        words = x.split()
        return {x, " ".join(words[:-1])} if len(words) > 1 and words[-1] in ("group", "team") else {x}

    def near(x: str, y: str) -> float:
        r = max(SequenceMatcher(None, p, q).ratio() for p in forms(x) for q in forms(y))
        inside = set(x.split()) and set(x.split()) <= set(y.split())
        return r if r >= SIMILAR or inside else 0.0

    return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)])


#: Fixed order: a blank and the letters of English text, most frequent first. It decides how much is compared, never what is found.
_FREQUENT = " etaoinshrdlucmfwygpbvkxqjz"


def _bare(c: str) -> Column:
    return F.regexp_replace(F.col(c), " (?:group|team)$", "")


def _signature(form: Column) -> Column:
    """The text's letters, each with how many of it came before, rarest first: two texts share as many of these as letters, counted."""
    letters = F.filter(F.split(form, ""), lambda c: c != "")
    numbered = F.transform(letters, lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice(letters, 1, i + 1), lambda x: x == c)).alias("k")))
    rarity = lambda s: F.when(F.instr(F.lit(_FREQUENT), s["c"]) == 0, len(_FREQUENT)).otherwise(F.instr(F.lit(_FREQUENT), s["c"])) + 6 * s["k"]
    keyed = F.transform(numbered, lambda s: F.struct((-rarity(s)).alias("r"), F.concat_ws(":", s["c"], s["k"].cast("string")).alias("t")))
    return F.transform(F.array_sort(keyed), lambda s: s["t"])


def _least(a: Column, b: Column) -> Column:
    """How many letters two texts of these lengths share at least, if their ratio reaches SIMILAR."""
    return F.ceil((a + b) * F.lit(SIMILAR / 2) - 1e-9)


def alike(labels: DataFrame, typed: DataFrame) -> DataFrame:
    """(id, q, shared, bound) of labels (id, f) and typed texts (q) where twice the letters that both have, over all letters, reaches SIMILAR:
    no ratio of sequences is above that bound, so nothing similar is missing. Ids of one text are told apart; texts that are empty have none.

    Texts that share that many letters share one among the first few of each, rarest first; that letter and the label's length are what is
    joined on, and where it stands must leave enough letters to share. So labels without such a letter are never met.
    """
    own = labels.select("id", "f").filter("f <> ''").distinct().withColumn("sig", _signature(F.col("f")))
    asked = typed.select("q").filter("q <> ''").distinct().withColumn("sig_q", _signature(F.col("q")))
    n, m = F.size("sig"), F.size("sig_q")
    # A label of n letters answers texts of at least SIMILAR / (2 - SIMILAR) of them; the shorter the text, the fewer need be shared.
    shortest = lambda x: F.ceil(x * F.lit(SIMILAR / (2 - SIMILAR)) - 1e-9)
    longest = lambda x: F.floor(x * F.lit((2 - SIMILAR) / SIMILAR) + 1e-9)
    index = own.select("id", "sig", n.alias("n"), F.posexplode(F.slice("sig", 1, (n - _least(n, shortest(n)) + 1).cast("int"))).alias("at", "t"))
    wanted = asked.select("q", "sig_q", m.alias("m"), F.explode(F.sequence(shortest(m).cast("int"), longest(m).cast("int"))).alias("n"))
    wanted = wanted.select("q", "sig_q", "m", "n", F.posexplode(F.slice("sig_q", 1, (F.col("m") - _least(F.col("m"), F.col("n")) + 1).cast("int"))).alias("at_q", "t"))
    need = _least(F.col("n"), F.col("m"))
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("at_q"))
    met = index.join(wanted, ["n", "t"]).filter(room >= need)
    # A pair meets by each letter that fits; it is kept at the first that both have, after which come all the others that they share.
    first = F.element_at(F.array_intersect("sig_q", "sig"), 1)
    met = met.filter(F.col("t") == first).withColumn("shared", F.size(F.array_intersect("sig", "sig_q")))
    return met.filter(F.col("shared") >= need).select("id", "q", "n", "m", "shared", F.round(2.0 * F.col("shared") / (F.col("n") + F.col("m")), 9).alias("bound"))


def _words(c: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(F.col(c)), r"\s+"), lambda w: w != ""))


def _holding(own: DataFrame, asked: DataFrame, holders: DataFrame) -> DataFrame:
    """(f, q) of labels that hold all words of a typed text: they are met by its rarest word alone."""
    rarest = asked.select("q", F.explode(_words("q")).alias("word")).join(holders, "word", "left").groupBy("q").agg(F.min_by("word", F.struct(F.coalesce("holders", F.lit(0)).alias("h"), "word")).alias("word"))
    met = own.select("f", F.explode(_words("f")).alias("word")).join(rarest, "word")
    return met.filter(F.size(F.array_except(_words("q"), _words("f"))) == 0).select("f", "q")


def suggested(labels: DataFrame, typed: DataFrame, most: int = MOST) -> DataFrame:
    """(typed, id, label, ratio, place): the best label of each of the `most` nearest entities. Names over LONGEST characters get none.

    A label is near at a ratio of SIMILAR, with or without a last word group or team on either side, or if it holds all typed words. Labels
    meet a name by a letter that both must share (`alike`) or by its rarest word; sequences are compared for these only. Among equals the one
    that shares the rarest word goes first.
    """
    closeness = F.pandas_udf(_closeness, "double")
    own = labels.select("id", "label", folded("label").alias("f")).filter("f is not null")
    asked = typed.filter(F.length("typed") <= LONGEST).select("typed", folded("typed").alias("q")).filter("q <> ''")
    words = own.select("id", F.explode(_words("f")).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("holders"))
    texts = own.select("f").distinct()
    forms = lambda df, c: df.withColumn("form", F.explode(F.array_distinct(F.array(F.col(c), _bare(c)))))
    fit = forms(texts, "f").filter(F.length("form") <= int(LONGEST * (2 - SIMILAR) / SIMILAR)).select(F.col("f").alias("id"), F.col("form").alias("f"))
    close = alike(fit, forms(asked, "q").select(F.col("form").alias("q"))).select(F.col("id").alias("f"), F.col("q").alias("form"))
    near = close.join(forms(asked.select("q").distinct(), "q"), "form").select("f", "q")
    compared = near.unionByName(_holding(texts, asked.select("q").distinct(), words)).distinct().select("q", "f", F.round(closeness("q", "f"), 9).alias("ratio")).filter("ratio > 0")
    scored = compared.join(asked, "q").join(own.select("id", "label", "f"), "f").select("typed", "id", "label", "q", "f", "ratio")
    best = scored.groupBy("typed", "id").agg(F.max_by("label", F.struct("ratio", "label")).alias("label"), F.max("ratio").alias("ratio"))
    shared = scored.select("typed", "id", F.explode(F.array_intersect(_words("q"), _words("f"))).alias("word")).join(words, "word").groupBy("typed", "id").agg(F.min("holders").alias("rarest"))
    place = F.row_number().over(Window.partitionBy("typed").orderBy(F.desc("ratio"), F.asc_nulls_last("rarest"), "id"))
    return best.join(shared, ["typed", "id"], "left").withColumn("place", place).filter(F.col("place") <= most).drop("rarest")


def others(labels: DataFrame, resolved: DataFrame) -> DataFrame:
    """(typed, id, label): entities besides the one that a typed name was resolved to (typed, id) whose label has the typed name's loose key.
    label: the one of the lowest tier, where labels have a tier, then the first by text. Names without letters or digits have no others."""
    tier = F.col("tier") if "tier" in labels.columns else F.lit(0)
    keyed = labels.select("id", "label", tier.alias("_tier"), loose_key(folded("label")).alias("l")).filter("l <> ''")
    own = resolved.select("typed", F.col("id").alias("_own"), loose_key(folded("typed")).alias("l"))
    return own.join(keyed, "l").filter("id <> _own").groupBy("typed", "id").agg(F.min_by("label", F.struct("_tier", "label")).alias("label"))
