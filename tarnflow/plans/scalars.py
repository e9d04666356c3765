"""Scalar functions and smaller operators on the driver's tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.functions import ids, text
from tarnflow.operators import changes
from tarnflow.plans.queries import joined, t
from tarnflow.plans.registry import query
from tarnflow.session import shared_dir


@query("""select o_orderkey, case when o_orderpriority in ('1-URGENT') then 'I' when o_orderpriority in ('2-HIGH', '3-MEDIUM') then 'II' else 'III' end as cat, o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') as known from orders""")
def severity_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity levels to categories; unknown levels rank lowest and are told apart."""
    level = F.when(F.col("o_orderpriority") == "1-URGENT", " High ").when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "medium").when(F.col("o_orderpriority") == "5-LOW", "LOW").otherwise("odd")
    return t(spark, sf_dir, "orders").select("o_orderkey", ids.severity_cat(level).alias("cat"), ids.is_known_level(level).alias("known"))


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 0 else (o_orderkey % 40)::int end as major, (o_orderkey % 13)::int as release from orders""")
def version_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(major, release) with 0 for what can't be read."""
    version = F.when(F.col("o_orderkey") % 3 == 0, "draft").otherwise((F.col("o_orderkey") % 40).cast("string"))
    info = F.concat(F.lit("Release:  "), (F.col("o_orderkey") % 13).cast("string"), F.lit(" Benchmark"))
    return t(spark, sf_dir, "orders").select("o_orderkey", ids.major(version).alias("major"), ids.release_number(info).alias("release"))


@query("""select s_suppkey, lower(s_name || ' ' || replace(replace(s_name || '_x-y', '_', ' '), '-', ' ')) as keywords from supplier""")
def product_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title with its id's separators as spaces."""
    return t(spark, sf_dir, "supplier").select("s_suppkey", ids.keywords(F.col("s_name"), F.concat("s_name", F.lit("_x-y"))).alias("keywords"))


@query("""with n as (select p_partkey, case p_partkey % 8 when 0 then 'U_' || p_partkey || '_V1R2_STIG.zip' when 1 then 'readme.txt' when 2 then p_partkey || '.zip' when 3 then 'U_SRG-STIG_Library_July_2026.zip' when 4 then 'U_X_SCAP_1-2_STIG.zip' when 5 then 'U_STIGViewer-3.zip' when 6 then 'U_Other.zip' else 'U_X_SRG_V1.zip' end as name from part)
select p_partkey, case when not ends_with(lower(name), '.zip') then null when not starts_with(lower(name), 'u_') or starts_with(lower(name), 'u_stigviewer-') then 'junk' when contains(lower(name), 'srg-stig') or contains(lower(name), 'compilation') then 'compilation'
 when contains(lower(name), '_scap_') or contains(lower(name), '_srg') then 'adversarial' when contains(lower(name), '_stig') then 'benchmark' else 'adversarial' end as tier from n""")
def archive_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """published names to tiers, the first rule that fits."""
    k, key = F.col("p_partkey") % 8, F.col("p_partkey").cast("string")
    name = F.when(k == 0, F.concat(F.lit("U_"), key, F.lit("_V1R2_STIG.zip"))).when(k == 1, "readme.txt").when(k == 2, F.concat(key, F.lit(".zip"))).when(k == 3, "U_SRG-STIG_Library_July_2026.zip").when(k == 4, "U_X_SCAP_1-2_STIG.zip").when(k == 5, "U_STIGViewer-3.zip").when(k == 6, "U_Other.zip").otherwise("U_X_SRG_V1.zip")
    return t(spark, sf_dir, "part").select("p_partkey", ids.archive_tier(name).alias("tier"))


@query("""with n as (select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m from orders) select y::int as "year", m::int as "month", count(*) as n from n where o_orderkey % 3 <> 2 group by 1, 2 union all select 0, 0, count(*) from n where o_orderkey % 3 = 2""")
def library_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release months out of names, by word or number."""
    date, k = F.col("o_orderdate"), F.col("o_orderkey") % 3
    word, number = F.date_format(date, "MMMM_yyyy"), F.date_format(date, "yyyy_MM")
    name = F.when(k == 0, F.concat(F.lit("U_SRG-STIG_Library_"), word, F.lit(".zip"))).when(k == 1, F.concat(F.lit("U_SRG-STIG_Library_"), number, F.lit("v2.zip"))).otherwise(F.lit("U_Library.zip"))
    return t(spark, sf_dir, "orders").select(ids.library_order(name).alias("o")).groupBy(F.col("o.year").alias("year"), F.col("o.month").alias("month")).agg(F.count("*").alias("n"))


@query("""with n as (select s_nationkey, s_suppkey % 2 as scheme, (s_suppkey % 7)::int as a, (s_suppkey % 11)::int as b from supplier)
select 'U_P' || s_nationkey as product, case scheme when 0 then 'VR' else 'YM' end as scheme, max((a, b))[1]::int as a, max((a, b))[2]::int as b from n group by s_nationkey, scheme""")
def newest_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest release of each product and scheme, read off names."""
    k = F.col("s_suppkey")
    name = F.when(k % 2 == 0, F.format_string("U_P%d_V%dR%d_STIG.zip", "s_nationkey", k % 7, k % 11)).otherwise(F.format_string("U_P%d_Y%02dM%02d_STIG.zip", "s_nationkey", k % 7, k % 11))
    rows = t(spark, sf_dir, "supplier").select(ids.release_of(name).alias("r"))
    best = rows.groupBy("r.product", "r.scheme").agg(F.max(F.struct("r.a", "r.b")).alias("m"))
    return best.select("product", "scheme", "m.a", "m.b")


@query("""with v as (select s_nationkey, s_suppkey % 12 as a, s_suppkey % 5 as b from supplier), d as (select distinct * from v) select s_nationkey, string_agg(a || '.' || b, ',' order by a, b) as versions from d group by 1""")
def sorted_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted versions in order of their parts."""
    k = F.col("s_suppkey")
    listed = t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_set(F.concat_ws(".", (k % 12).cast("string"), (k % 5).cast("string"))).alias("v"))
    return listed.select("s_nationkey", joined(ids.sorted_versions(F.col("v"))).alias("versions"))


@query("""select o_orderkey, case when o_orderkey % 4 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as day, case when o_orderkey % 4 = 0 then null else year(o_orderdate)::int end as major from orders""")
def dates_and_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date part of a stamp; a strict MAJOR.MINOR."""
    bad = F.col("o_orderkey") % 4 == 0
    stamp = F.when(bad, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    pair = F.when(bad, "1.2.3").otherwise(F.date_format("o_orderdate", "yyyy.MM"))
    return t(spark, sf_dir, "orders").select("o_orderkey", ids.date_part(stamp).alias("day"), ids.version_pair(pair)["major"].alias("major"))


@query("""select doc_id, sha256(text) as sha256, strlen(text) as size from documents""")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash and size of contents."""
    made = t(spark, sf_dir, "documents").select("doc_id", ids.file_digest(F.encode("text", "UTF-8")).alias("d"))
    return made.select("doc_id", "d.sha256", "d.size")


@query("""select p_partkey, not (p_partkey % 5 in (0, 1, 2)) as bare, p_partkey % 5 = 1 as barred from part""")
def name_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a path in them, and parts that are out of scope."""
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, "..").when(k == 1, "a/CUI_b.zip").when(k == 2, "a\\b").when(k == 3, "ok.zip").otherwise(".hidden")
    return t(spark, sf_dir, "part").select("p_partkey", ids.is_bare_name(name).alias("bare"), ids.holds_barred_part(name).alias("barred"))


@query("""with w as (select p_partkey, lower(p_name || ' guide win ' || p_size) as x from part), tok as (select p_partkey, list_distinct(regexp_extract_all(x, '[a-z0-9]+')) as l from w)
select p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(l, lambda t: not regexp_matches(t, '^[0-9]+$') and t <> 'guide'), ['windows']))), ',') as product, array_to_string(list_sort(list_filter(l, lambda t: regexp_matches(t, '^[0-9]+$'))), ',') as version,
 case when list_contains(l, 'windows') then '' else 'windows' end as expanded from tok""")
def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product and version tokens, synonyms spelt out, stop tokens gone."""
    made = t(spark, sf_dir, "part").select("p_partkey", text.normalized(F.concat("p_name", F.lit(" guide win "), F.col("p_size").cast("string"))).alias("t"))
    return made.select("p_partkey", joined("t.product").alias("product"), joined("t.version").alias("version"), joined("t.expanded").alias("expanded"))


@query("""select p_partkey, (p_size || '') as glued, (p_size % 10)::varchar as unpadded from part""")
def glued_and_unpadded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions glued to a letter; leading zeros."""
    size = F.col("p_size").cast("string")
    glued = text.glued_versions(F.array(F.concat(F.lit("v"), size), F.lit("jamf"), F.lit("2740s")))
    return t(spark, sf_dir, "part").select("p_partkey", joined(glued).alias("glued"), ids.unpadded(F.concat(F.lit("00"), (F.col("p_size") % 10).cast("string"))).alias("unpadded"))


@query("""select p_partkey, (p_size % 3 in (0, 1)) as held, case p_size % 3 when 0 then '08' when 1 then '8' else '' end as versions from part""")
def satisfied_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token held as it is or spelt out; query versions without their zeros."""
    k = F.col("p_size") % 3
    document = F.when(k == 0, text.strings(["red", "hat", "enterprise", "linux", "8"])).when(k == 1, text.strings(["rhel", "8"])).otherwise(text.strings(["red", "hat"]))
    asked = F.when(k == 0, text.strings(["08", "9"])).when(k == 1, text.strings(["8"])).otherwise(text.strings(["8"]))
    return t(spark, sf_dir, "part").select("p_partkey", text.satisfied(F.lit("rhel"), document).alias("held"), joined(text.matched_versions(asked, document)).alias("versions"))


@query("""select p_partkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(p_size || '.' || p_partkey || ' x' || (p_partkey % 9), '[0-9]+(?:[.-][0-9]+)*'), lambda r: regexp_extract(r, '^[0-9]+')))), ',') as majors from part""")
def version_majors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first part of every version in a text."""
    said = F.concat(F.col("p_size").cast("string"), F.lit("."), F.col("p_partkey").cast("string"), F.lit(" x"), (F.col("p_partkey") % 9).cast("string"))
    return t(spark, sf_dir, "part").select("p_partkey", joined(text.version_majors(said)).alias("majors"))


@query("""select concat_ws('/', o_orderkey::varchar, o_orderstatus) as key, case when o_orderkey % 2 = 0 then 'm' || o_orderkey || '.zip' else 'a.zip' end as file from orders""")
def benchmark_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id/version keys; the file that a row came from."""
    even = F.col("o_orderkey") % 2 == 0
    member = F.concat(F.lit("x/y/m"), F.col("o_orderkey").cast("string"), F.lit(".zip"))
    return t(spark, sf_dir, "orders").select(ids.benchmark_key(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")).alias("key"), ids.source_file(F.when(even, "library").otherwise("loose"), F.lit("d/a.zip"), member).alias("file"))


@query("""with l as (select s_nationkey, list_sort(list(s_suppkey::varchar)) as l from supplier group by 1)
select s_nationkey, array_to_string(l[1:4], ', ') || case when len(l) > 4 then ', and ' || (len(l) - 4) || ' more' else '' end as listed from l""")
def capped_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most four, and how many more."""
    listed = t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(F.col("s_suppkey").cast("string"))).alias("l"))
    return listed.select("s_nationkey", ids.capped(F.col("l")).alias("listed"))


@query("""select p_brand, string_agg(distinct p_size::varchar, ',' order by p_size::varchar) as shared from part where p_size in (select p_size from part where p_brand = 'Brand#11') group by 1""")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a row's set shares with another's."""
    sets = t(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.col("p_size").cast("string")).alias("s"))
    one = sets.filter("p_brand = 'Brand#11'").select(F.col("s").alias("o"))
    both = sets.join(F.broadcast(one))  # one row
    return both.select("p_brand", joined(F.array_sort(F.array_intersect("s", "o"))).alias("shared")).filter("shared <> ''")


@query("""select l_orderkey, array_to_string(list_transform(list_sort(list(struct_pack(k := m, s := l_suppkey))), lambda x: x.s::varchar), ',') as suppliers from (select l_orderkey, l_suppkey, min(l_linenumber) as m from lineitem group by 1, 2) group by 1""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct items in the order in which they came."""
    lists = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    return lists.select("l_orderkey", joined(F.transform(F.array_distinct(F.transform("l", lambda x: x["l_suppkey"])), lambda s: s.cast("string"))).alias("suppliers"))


@query("""select r_name as source_name, string_agg(n_name, ',' order by n_name) as versions from region join nation on n_regionkey = r_regionkey where not starts_with(n_name, 'NATION_1') group by 1""")
def keyed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata rows less a prefix, by key."""
    nation = t(spark, sf_dir, "nation").filter(~F.startswith("n_name", F.lit("NATION_1")))
    rows = t(spark, sf_dir, "region").join(nation, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("source_name")).agg(joined(F.sort_array(F.collect_list("n_name"))).alias("versions"))


@query("""select o_orderkey, case when o_orderpriority = '1-URGENT' then o_orderstatus end as title, 'disa' as catalog, o_orderkey || '/' || o_custkey as benchmark from orders where o_custkey in (1, 2, 3, 5, 8, 13, 21)""")
def compact_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id list; titles for the top category alone; a constant column."""
    rows = t(spark, sf_dir, "orders").filter(F.col("o_custkey").isin(1, 2, 3, 5, 8, 13, 21))
    return rows.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("title"), F.lit("disa").alias("catalog"), ids.benchmark_key(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("benchmark"))


@query("""with a as (select s_suppkey, (s_suppkey % 20) as x, (s_suppkey % 4) as y from supplier) select s_suppkey, case when s_suppkey % 10 = 9 then 'incomparable' when (x, y) < (10, 2) then 'newer' when (x, y) > (10, 2) then 'older' else 'same' end as state from a""")
def currency_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored against published, by parts of the version."""
    k = F.col("s_suppkey")
    stored = F.when(k % 10 == 9, "n/a").otherwise(F.concat_ws(".", (k % 20).cast("string"), (k % 4).cast("string")))
    return t(spark, sf_dir, "supplier").select("s_suppkey", changes.compared(ids.dotted(stored), ids.dotted(F.lit("10.2"))).alias("state"))


@query("""select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def unrecorded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there and not recorded."""
    from tarnflow.operators import quality

    return quality.unrecorded(t(spark, sf_dir, "orders").select("o_orderkey"), t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""select lower(p_type) as folded, count(*) as n, min(p_type) as spelling from part group by 1""")
def spellings_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored spellings of each folded key."""
    return t(spark, sf_dir, "part").groupBy(F.lower("p_type").alias("folded")).agg(F.count("*").alias("n"), F.min("p_type").alias("spelling"))


@query("""select p_type, score, place from (select p_type, p_partkey, round(p_retailprice / 100, 9) as score, row_number() over (partition by p_type order by round(p_retailprice / 100, 9) desc, p_partkey)::int as place from part) where place <= 3""")
def best_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each group, earlier ones first among equals."""
    rows = t(spark, sf_dir, "part").select("p_type", "p_partkey", F.round(F.col("p_retailprice") / 100, 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("score"), "p_partkey"))
    return rows.withColumn("place", place).filter("place <= 3").select("p_type", "score", "place")


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by window and type: the same plan on a stream."""
    from tarnflow.streaming import refresh

    made = refresh.event_counts(t(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), window="1 hour")
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def _archiver(folder: str):
    """Documents of a group as an archive of archives: one inner archive a language, and one that is damaged. Every second outer archive is compressed."""

    def write(rows):
        import io
        import zipfile

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        group, inner = rows["group"][0].as_py(), {}
        for r in sorted(rows.to_pylist(), key=lambda r: r["doc_id"]):
            inner.setdefault(r["lang"], []).append(r)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if group % 2 else zipfile.ZIP_STORED) as outer:
            for lang, docs in sorted(inner.items()):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for r in docs:
                        z.writestr(f"d/{r['doc_id']}{'_Manual' if r['doc_id'] % 3 == 0 else ''}-xccdf.xml", r["text"])
                outer.writestr(f"{lang}.zip", held.getvalue())
            outer.writestr("broken.zip", b"no archive")
        name, aside = f"U_SRG-STIG_Library_{group}.zip", f"{base}/.{uuid.uuid4().hex}"
        store.create_dir(base, recursive=True)
        with store.open_output_stream(aside) as f:
            f.write(out.getvalue())
        store.move(aside, f"{base}/{name}")
        return pa.table({"path": [f"{folder}/{name}"], "name": [name], "length": [out.tell()]})

    return write


@query("""with d as (select doc_id, lang, text, doc_id // 200 as g from documents),
m as (select *, bool_or(doc_id % 3 = 0) over (partition by g, lang) as manual from d)
select 'U_SRG-STIG_Library_' || g || '.zip' as source_artifact, 'library' as origin, lang || '.zip' as source_member, 'd/' || doc_id || case when doc_id % 3 = 0 then '_Manual' else '' end || '-xccdf.xml' as source_document, sha256(text) as sha256, false as damaged
from m where doc_id % 3 = 0 or not manual
union all select distinct 'U_SRG-STIG_Library_' || g || '.zip', 'library', 'broken.zip', null, null, true from d""")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in archives of archives, read back by byte ranges of the outer ones."""
    from tarnflow.sources import archives

    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.expr("doc_id div 200").alias("group"))
    written = docs.groupBy("group").applyInArrow(_archiver(folder), "path string, name string, length long")  # 200 documents each
    written.write.parquet(f"{folder}/written")
    inventory = spark.read.parquet(f"{folder}/written").withColumn("kind", F.lit("library"))
    found = archives.benchmark_documents(inventory, 1 << 16)
    return found.select("source_artifact", "origin", "source_member", "source_document", F.sha2("content", 256).alias("sha256"), F.col("problem").isNotNull().alias("damaged"))


