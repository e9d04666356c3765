"""Free text to benchmarks: fragments, idf-weighted coverage, confidence, build applicability, verdicts on versions, and top-k by benchmark.

Descriptions are requests, so few and short; benchmarks are the corpus. Scores are sums over sorted weights, rounded to 9 places before
they are compared, so they don't depend on how rows were dealt.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.functions import ids, text
from tarnflow.operators.rank import EPSILON
from tarnflow.session import shared_dir

FLOOR, PRODUCT_SHARE, VERSION_SHARE, DISTINCTIVE = 10.0, 0.8, 0.2, 0.05
_SEPARATOR = re.compile(r",|\band\b", re.IGNORECASE)


@dataclass
class Rules:
    """aliases: benchmark id -> phrases. entries: name, id pattern, build pattern (group n), thresholds (least build, version or None)."""

    aliases: dict[str, list[str]] = field(default_factory=dict)
    entries: list[tuple[str, str, str, list[tuple[int, str | None]]]] = field(default_factory=list)

    def checked(self) -> "Rules":
        for name, pattern, build, steps in self.entries:
            re.compile(pattern)
            if "n" not in re.compile(build, re.IGNORECASE).groupindex:
                raise ValueError(f"{name}: the build pattern has no group n")
            if 0 not in [least for least, _ in steps] or any(v is not None and not isinstance(v, str) for _, v in steps):
                raise ValueError(f"{name}: a threshold from 0 is needed, and versions are texts")
        return self


def corpus(stigs: DataFrame) -> DataFrame:
    """stigs with tokens: product, version, document (both), covered (version and glued ones) and written (the title's version runs)."""
    t = text.normalized(F.concat_ws(" ", "title", F.coalesce("product_keywords", F.lit(""))))
    rows = stigs.withColumn("_t", t).withColumn("product", F.col("_t.product")).withColumn("version_tokens", F.col("_t.version")).drop("_t")
    rows = rows.withColumn("document", F.array_union("product", "version_tokens")).withColumn("written", text.version_runs(F.col("title")))
    return rows.withColumn("covered", F.array_union("version_tokens", text.glued_versions(F.col("product"))))


def frequencies(docs: DataFrame) -> DataFrame:
    """(token, df) over all rows."""
    return docs.select(F.explode("document").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def straddling_pairs(stigs: DataFrame) -> DataFrame:
    """(before, after): words on both sides of a separator inside a benchmark's own title."""
    around = r"(?i)([A-Za-z0-9]+)[^A-Za-z0-9]*(?:,|\band\b)[^A-Za-z0-9]*([A-Za-z0-9]+)"
    pairs = F.explode(F.arrays_zip(F.regexp_extract_all("title", F.lit(around), F.lit(1)).alias("before"), F.regexp_extract_all("title", F.lit(around), F.lit(2)).alias("after")))
    return stigs.select(pairs.alias("p")).select(F.lower("p.before").alias("before"), F.lower("p.after").alias("after")).distinct()


def split(description: str, protected: set[tuple[str, str]] = frozenset()) -> list[str]:
    """The description's parts, divided at commas and the word and, except between a protected pair of words."""
    pieces, last = [], 0
    for m in _SEPARATOR.finditer(description):
        before, after = re.findall(r"[A-Za-z0-9]+", description[: m.start()]), re.findall(r"[A-Za-z0-9]+", description[m.end() :])
        if before and after and (before[-1].lower(), after[0].lower()) in protected:
            continue
        pieces.append(description[last : m.start()])
        last = m.end()
    return [p.strip() for p in [*pieces, description[last:]] if p.strip()]


def without_build(fragment: str, rules: Rules) -> tuple[str, int | None]:
    """The fragment without the build that the first fitting entry reads in it, and that build."""
    for _, _, pattern, _ in rules.entries:
        if m := re.search(pattern, fragment, re.IGNORECASE):
            return " ".join((fragment[: m.start()] + " " + fragment[m.end() :]).split()), int(m["n"] or 0)
    return fragment, None


def applicability(stig_id: Column, version: Column, build: Column, rules: Rules) -> Column:
    """struct(applicable, reason, wanted) of a benchmark's row at a build."""

    def made(yes: Column, reason: str, wanted: Column | None = None) -> Column:
        return F.struct(yes.alias("applicable"), F.lit(reason).alias("reason"), (wanted if wanted is not None else F.lit(None).cast("string")).alias("wanted"))

    out = F.when(build.isNotNull(), made(F.lit(True), "ungoverned-build")).otherwise(made(F.lit(True), None))
    for _, pattern, _, steps in reversed(rules.entries):
        wanted = F.lit(None).cast("string")
        for least, v in sorted(steps, key=lambda s: s[0]):
            wanted = F.when(build >= least, F.lit(v)).otherwise(wanted)
        own = (
            F.when(build.isNull(), made(F.lit(True), "ambiguous-no-build"))
            .when(wanted.isNull(), made(F.lit(False), "no-official-stig"))
            .when(wanted == version, made(F.lit(True), "scoped"))
            .otherwise(made(F.lit(False), "superseded-major", wanted))
        )
        out = F.when(stig_id.rlike(pattern), own).otherwise(out)
    return out


def _weight(tokens: Column) -> Column:
    """The sum of the tokens' idf from the map column _idf, 1 for unknown ones, in the order of size."""
    return F.aggregate(F.array_sort(F.transform(tokens, lambda t: F.coalesce(F.try_element_at("_idf", t), F.lit(1.0)))), F.lit(0.0), lambda a, w: a + w)


#: What the index adds to a benchmark's own columns.
_TOKENS = ("product", "version_tokens", "document", "written", "covered")


@dataclass
class Corpus:
    """What every request needs of the benchmarks, as an index on disk that is bound to a version of them: docs (benchmarks with their tokens),
    postings (token, stig_id, version) and known (token, df), both in order of tokens, so that a request reads the row groups of its own."""

    docs: DataFrame
    postings: DataFrame
    known: DataFrame
    n: int
    protected: set[tuple[str, str]]
    version: str

    @classmethod
    def written(cls, stigs: DataFrame, path: str, version: str) -> "Corpus":
        """Tokenise the benchmarks once and write the index to a new folder."""
        spark = stigs.sparkSession
        corpus(stigs).write.parquet(f"{path}/docs")
        docs = spark.read.parquet(f"{path}/docs")
        postings = docs.select(F.explode("document").alias("token"), "stig_id", "version")
        _by_token(postings).write.option("parquet.bloom.filter.enabled#token", "true").parquet(f"{path}/postings")
        _by_token(spark.read.parquet(f"{path}/postings").groupBy("token").agg(F.count("*").alias("df"))).write.parquet(f"{path}/known")
        straddling_pairs(docs).coalesce(1).write.parquet(f"{path}/pairs")
        docs.agg(F.count("*").alias("n")).withColumn("corpus_version", F.lit(version)).coalesce(1).write.parquet(f"{path}/meta")  # last: an index without it isn't whole
        return cls.opened(spark, path, version)

    @classmethod
    def opened(cls, spark: SparkSession, path: str, version: str) -> "Corpus":
        """The index in a folder; LookupError if it is of another version or isn't whole."""
        try:
            meta = spark.read.parquet(f"{path}/meta").first()
        except AnalysisException as e:
            raise LookupError(f"no index of {version} in {path}") from e
        if meta.corpus_version != version:
            raise LookupError(f"the index in {path} is of {meta.corpus_version}, not of {version}")
        read = {t: spark.read.parquet(f"{path}/{t}") for t in ("docs", "postings", "known", "pairs")}
        return cls(read["docs"], read["postings"], read["known"], meta.n, {(r.before, r.after) for r in read["pairs"].collect()}, version)  # word pairs inside titles: a few

    @property
    def columns(self) -> list[str]:
        return [c for c in self.docs.columns if c not in _TOKENS]


def _by_token(df: DataFrame) -> DataFrame:
    """df in order of tokens; a token that is in most titles is spread over files by its rows."""
    return df.repartitionByRange("token", *[c for c in df.columns if c != "token"]).sortWithinPartitions("token")


def resolve(stigs: DataFrame | Corpus, descriptions: DataFrame, rules: Rules | None = None, limit: int = 5) -> tuple[DataFrame, DataFrame]:
    """(hits, verdicts) for descriptions (request, description). stigs: the index of the benchmarks, or the benchmarks themselves, of which an
    index is then written, used and deleted; what is returned is local to the driver in that case, as it has the requests' size.

    hits: request, benchmark columns, score, matched_on, high_confidence, applicable, reason, wanted, tied_omitted: all rows of the `limit`
    best benchmarks of each request. verdicts: request, fragment_pos, fragment, verdict (uncovered or version-agnostic), benchmarks,
    covered_versions, fragment_confident.
    """
    if isinstance(stigs, Corpus):
        return _resolved(stigs, descriptions, rules, limit)
    spark = stigs.sparkSession
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    try:
        found = _resolved(Corpus.written(stigs, path, path), descriptions, rules, limit)
        return tuple(spark.createDataFrame(df.collect(), df.schema) for df in found)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def _resolved(held: Corpus, descriptions: DataFrame, rules: Rules | None, limit: int) -> tuple[DataFrame, DataFrame]:
    rules, spark = (rules or Rules()).checked(), descriptions.sparkSession
    docs, known, n, protected, columns = held.docs, held.known, held.n, held.protected, held.columns
    parts = [(r.request, k, f, *without_build(f, rules)) for r in descriptions.collect() for k, f in enumerate(split(r.description, protected) or [r.description])]  # requests
    asked = spark.createDataFrame(parts, "request long, fragment_pos int, fragment string, stripped string, build int")
    asked = asked.withColumn("q", text.normalized(F.col("stripped"))).select("*", F.col("q.product").alias("qp"), F.col("q.version").alias("qv"), text.version_majors(F.col("stripped")).alias("qm")).drop("q")
    asked = spark.createDataFrame(asked.collect(), asked.schema)  # requests: few rows, and read many times from here
    # Each query token's frequency; the corpus is met only by rows that share a token, an expansion's token or an alias.
    wanted = asked.select("request", "fragment_pos", F.explode(F.array_distinct(F.concat("qp", "qv", F.transform("qv", ids.unpadded)))).alias("token"))
    wanted = wanted.join(known.filter(F.col("token").isin([r.token for r in wanted.distinct().select("token").collect()])), "token", "left")
    idf = F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1
    maps = wanted.filter("df is not null").groupBy("request", "fragment_pos").agg(F.map_from_entries(F.collect_list(F.struct("token", "df"))).alias("_df"), F.map_from_entries(F.collect_list(F.struct(F.col("token"), idf.alias("idf")))).alias("_idf"))
    asked = asked.join(maps, ["request", "fragment_pos"], "left").withColumn("_df", F.coalesce("_df", F.create_map().cast("map<string,bigint>"))).withColumn("_idf", F.coalesce("_idf", F.create_map().cast("map<string,double>")))
    distinctive = F.filter("qp", lambda t: F.coalesce(F.try_element_at("_df", t), F.lit(0)) <= DISTINCTIVE * n)
    asked = asked.withColumn("rare", distinctive)
    asked = spark.createDataFrame(asked.collect(), asked.schema)  # requests: few rows, and read many times from here
    keys = F.array_distinct(F.concat("qp", "qv", F.transform("qv", ids.unpadded), F.flatten(F.transform("qp", lambda t: F.coalesce(text.expansion_of(t), F.array().cast("array<string>"))))))
    sought = asked.select("request", "fragment_pos", F.explode(keys).alias("token"))
    listed = held.postings.filter(F.col("token").isin([r.token for r in sought.select("token").distinct().collect()]))  # the requests' tokens
    met = listed.join(sought, "token").select("stig_id", "version", "request", "fragment_pos").distinct()
    for_alias = _alias_rows(spark, asked, rules)
    met = met.unionByName(docs.select("stig_id", "version").join(for_alias.select("stig_id", "request", "fragment_pos"), "stig_id")).distinct()
    both = met.join(docs, ["stig_id", "version"]).join(asked, ["request", "fragment_pos"]).join(for_alias, ["request", "fragment_pos", "stig_id"], "left")
    qp_met = F.filter("qp", lambda t: text.satisfied(t, F.col("product")))
    corpus_versions = F.transform("qv", lambda v: F.when(F.map_contains_key("_idf", v), v).otherwise(ids.unpadded(v)))
    by_version = F.when(F.size("qv") == 0, 0.0).otherwise(_weight(text.matched_versions(corpus_versions, F.col("document"))) / _weight(corpus_versions))
    share = F.when(F.size("qv") == 0, 1.0).otherwise(F.size(text.matched_versions(F.col("qv"), F.col("version_tokens"))) / F.size("qv"))
    by_product = F.when(F.size(qp_met) == 0, 0.0).otherwise(PRODUCT_SHARE * _weight(qp_met) / _weight(F.col("qp")) + VERSION_SHARE * share)
    score = F.when(F.col("alias").isNotNull(), 100.0).otherwise(F.round(100.0 * F.when(F.size("qp") == 0, by_version).otherwise(by_product), 9))
    has_rare = F.forall("rare", lambda t: text.satisfied(t, F.col("document")))
    sure = (F.size("rare") > 0) & has_rare & (F.size(text.matched_versions(F.col("qv"), F.col("document"))) == F.size("qv"))
    both = both.withColumn("score", score).filter(F.col("score") >= FLOOR)
    both = both.withColumn("confident", F.col("alias").isNotNull() | sure).withColumn("matched_on", F.when(F.col("alias").isNotNull(), F.concat(F.lit("alias:"), "alias")).otherwise("keyword"))
    both = both.withColumn("unnamed", F.size(F.array_except("document", F.array_union("qp", "qv")))).withColumn("holds_rare", has_rare)
    # The best fragment of each row: the first of equal ones.
    own = both.withColumn("_n", F.row_number().over(Window.partitionBy("request", "stig_id", "version").orderBy(F.desc("score"), "fragment_pos"))).filter("_n = 1").drop("_n")
    own = own.withColumn("a", applicability(F.col("stig_id"), F.col("version"), F.col("build"), rules)).select("*", "a.*")
    top = F.max("score").over(Window.partitionBy("request"))
    own = own.withColumn("high_confidence", F.col("confident") & (top - F.col("score") <= EPSILON))
    own = own.withColumn("unnamed", F.min("unnamed").over(Window.partitionBy("request", "stig_id")))
    rank = F.struct((-F.col("score")).alias("s"), (~F.col("high_confidence")).alias("c"), F.when(F.col("origin") == "library", 0).otherwise(1).alias("o"), "unnamed", "stig_id")
    own = own.withColumn("_rank", F.min(rank).over(Window.partitionBy("request", "stig_id")))
    own = own.withColumn("place", F.dense_rank().over(Window.partitionBy("request").orderBy("_rank")))
    own = own.withColumn("_cut", F.max(F.when(F.col("place") == limit, -F.col("_rank.s"))).over(Window.partitionBy("request")))
    own = own.withColumn("_first", F.row_number().over(Window.partitionBy("request", "stig_id").orderBy("version")) == 1)
    omitted = F.col("_first") & (F.col("place") > limit) & (F.abs(-F.col("_rank.s") - F.col("_cut")) <= EPSILON)
    hits = own.withColumn("tied_omitted", F.sum(F.when(omitted, 1).otherwise(0)).over(Window.partitionBy("request"))).filter(F.col("place") <= limit)
    kept = ["request", *columns, "score", "matched_on", "high_confidence", "applicable", "reason", "wanted", "build", "place", "tied_omitted"]
    return hits.select(*kept).orderBy("request", "place", "version"), _verdicts(both, asked)


def _alias_rows(spark, asked: DataFrame, rules: Rules) -> DataFrame:
    """(request, fragment_pos, stig_id, alias): the first alias of each benchmark all of whose required tokens are in the fragment."""
    table = spark.createDataFrame([(s, k, p) for s, phrases in rules.aliases.items() for k, p in enumerate(phrases)], "stig_id string, pos int, alias string")
    t = text.normalized(F.col("alias"))
    needed = F.filter(F.array_union(t["product"], t["version"]), lambda x: text.expansion_of(x).isNull())
    table = table.withColumn("required", needed).filter(F.size("required") > 0)
    query = asked.withColumn("all", F.array_union(F.array_union("qp", "qv"), F.transform("qv", ids.unpadded)))
    met = table.withColumn("token", F.get("required", 0)).join(query.select("request", "fragment_pos", "all", F.explode("all").alias("token")), "token")
    return met.filter(F.size(F.array_except("required", "all")) == 0).groupBy("request", "fragment_pos", "stig_id").agg(F.min_by("alias", "pos").alias("alias"))


def _verdicts(scored: DataFrame, asked: DataFrame) -> DataFrame:
    """Fragments that name a version which none of their best benchmarks covers."""
    top = F.max("score").over(Window.partitionBy("request", "fragment_pos"))
    best = scored.withColumn("_top", top)
    sure = best.groupBy("request", "fragment_pos").agg(F.max(F.col("confident") & (F.col("_top") - F.col("score") <= EPSILON)).alias("fragment_confident"))
    tier = best.filter("score = _top and size(qv) > 0 and size(rare) > 0").groupBy("request", "fragment_pos", "fragment", "qm").agg(
        F.sort_array(F.collect_set("stig_id")).alias("benchmarks"), F.bool_and("holds_rare").alias("held"), F.bool_and(F.size("covered") > 0).alias("all_pinned"), F.max(F.size("covered") > 0).alias("some_pinned"),
        F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered"), F.array_distinct(F.flatten(F.collect_list("written"))).alias("written"))
    open_tier = tier.filter(F.col("held") & (F.size(text.matched_versions(F.col("qm"), F.col("covered"))) == 0))
    verdict = F.when(F.col("all_pinned"), "uncovered").when(~F.col("some_pinned") & (F.size("written") == 0), "version-agnostic")
    found = open_tier.withColumn("verdict", verdict).filter("verdict is not null").join(sure, ["request", "fragment_pos"])
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("request", "fragment").orderBy("fragment_pos"))).filter("_n = 1")
    return found.select("request", "fragment_pos", "fragment", "verdict", "benchmarks", ids.sorted_versions(text.covered_versions(F.col("written"), F.col("covered"))).alias("covered_versions"), "fragment_confident")
