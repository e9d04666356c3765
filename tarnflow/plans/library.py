"""The library's larger operators on the driver's tables, called as a user calls them, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions import ids
from tarnflow.operators import arbitration, changes, currency, digest, resolver
from tarnflow.plans import build, conformance, notes, questions
from tarnflow.plans.queries import joined, t
from tarnflow.plans.registry import query
from tarnflow.session import stored
from tarnflow.sources import archives, documents, manifest

# --- documents


@query("""select l_orderkey as o_orderkey, o_orderstatus as version, l_linenumber - 1 as place, 'R' || l_orderkey || '_' || l_linenumber as rule_id,
case l_returnflag when 'R' then 'I' when 'A' then 'II' end as cat, l_returnflag = 'N' as rejected, case when l_returnflag = 'N' then null else 'CCI-' || l_suppkey end as ccis, floor(o_totalprice)::int::varchar as release
from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)::int as line from lineitem) l join orders on o_orderkey = l_orderkey""".replace("l_linenumber - 1", "line - 1").replace("'_' || l_linenumber", "'_' || line"))
def benchmark_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark in XML for each order, parsed again; rules without a severity are rejects."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("lines"))
    level = lambda x: F.when(x["l_returnflag"] == "R", ' severity="high"').when(x["l_returnflag"] == "A", ' severity="medium"').otherwise("")
    rule = lambda x, k: F.concat(F.lit('<Rule id="R'), F.col("l_orderkey").cast("string"), F.lit("_"), (k + 1).cast("string"), F.lit('"'), level(x), F.lit("><title> t </title><ident system='s'>CCI-"), x["l_suppkey"].cast("string"), F.lit("</ident><ident system='s'>OTHER-1</ident></Rule>"))
    rules = F.array_join(F.transform("lines", rule), "")
    head = F.format_string('<x:Benchmark xmlns:x="u" id="B%d"><status date="2026-01-02">accepted</status><title>T</title><plain-text id="release-info">%s</plain-text><version>%s</version><Group id="G">', "o_orderkey", F.col("o_totalprice").cast("int").cast("string"), "o_orderstatus")
    orders = t(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    files = orders.select("o_orderkey", F.concat(F.regexp_replace(head, "x:Benchmark xmlns:x", "Benchmark xmlns:x"), rules, F.lit("</Group></Benchmark>")).alias("content"))
    both = documents.rules(documents.benchmarks(files).withColumnRenamed("release_info", "release"), ["o_orderkey", "version", "release"])
    bare = F.col("rejected")
    return both.select("o_orderkey", "version", F.col("rule_pos").alias("place"), "rule_id", F.when(~bare, F.col("severity_cat")).alias("cat"), "rejected", F.when(~bare, joined("ccis")).alias("ccis"), "release")


_DOCS = """with d as (select o_orderkey as k, 'C' || (o_custkey % 50) || case when o_orderkey % 11 = 0 then '_SRG' else '_STIG' end as id, o_orderkey % 13 = 0 as broken, o_orderkey % 7 = 0 as draft, o_orderkey % 11 = 0 as srg, year(o_orderdate) - 1991 as major, month(o_orderdate) as rel,
    o_orderkey % 3 = 0 as lib, strftime(o_orderdate, '%Y-%m-%d') as dated, o_custkey::varchar as art, printf('%010d', o_orderkey) as doc from orders),
w as (select * from d where not broken and not draft and not srg),
g as (select *, row_number() over (partition by id, major order by rel desc, lib desc, dated desc, art desc, art || chr(0) || chr(0) || doc) as n, row_number() over (partition by id, major order by art || chr(0) || chr(0) || doc) as seq, (rel, lib, dated, art, -row_number() over (partition by id, major order by art || chr(0) || chr(0) || doc)) as own from w),
l as (select *, max(own) over (partition by id, major order by seq rows between unbounded preceding and 1 preceding) as lead from g),
f as (select struct_extract_at(greatest(own, lead), 2) and not struct_extract_at(least(own, lead), 2) as bylib from l where lead is not null),
win as (select *, max(case when lib then major end) over (partition by id) as top_lib, max(case when not lib then major end) over (partition by id) as top_own from g where n = 1),
kept as (select * from win where lib or case when top_lib is not null then major > top_lib else major = top_own end),
r as (select kept.*, 'P' || l_partkey as rule_id, l_returnflag = 'N' as bare, row_number() over (partition by k order by l_linenumber, l_partkey, l_suppkey) as place from kept join lineitem on l_orderkey = k),
h as (select *, row_number() over (partition by bare, rule_id order by dated desc, lib desc, id, major desc, place) = 1 as held from r)"""


def _benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents in XML, as archives.benchmark_documents gives them: a thirteenth is broken, others are drafts and guides."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("lines"))
    rule = lambda x: F.concat(F.lit('<Rule id="P'), x["l_partkey"].cast("string"), F.when(x["l_returnflag"] == "N", '">').otherwise('" severity="low">'), F.lit("<title>t</title></Rule>"))
    orders = t(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    k = F.col("o_orderkey")
    name = F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string"), F.when(k % 11 == 0, "_SRG").otherwise("_STIG"))
    text = F.concat(
        F.lit('<Benchmark id="'), name, F.lit('"><status date="'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('">'), F.when(k % 7 == 0, "draft").otherwise("accepted"), F.lit('</status><title>T</title><plain-text id="release-info">Release: '),
        F.month("o_orderdate").cast("string"), F.lit(" Benchmark Date: 1 Jan 2026</plain-text><version>"), (F.year("o_orderdate") - 1991).cast("string"), F.lit('</version><Group id="G">'),
        F.coalesce(F.array_join(F.transform("lines", rule), ""), F.lit("")), F.when(k % 13 == 0, "").otherwise("</Group></Benchmark>"))
    return orders.select(F.col("o_custkey").cast("string").alias("source_artifact"), F.when(k % 3 == 0, "library").otherwise("product").alias("origin"), F.lit(None).cast("string").alias("source_member"), F.format_string("%010d", k).alias("source_document"), text.alias("content"), F.lit(None).cast("string").alias("problem"))


@query(_DOCS + """select * from (select count(*) as stig_files, count(*) filter (where broken) as unreadable, count(*) filter (where not broken and draft) as skipped_draft, count(*) filter (where not broken and not draft and srg) as skipped_srg from d),
(select count(*) as stigs from kept), (select count(*) as superseded_by_newer_major from (select k from win except all select k from kept)),
(select count(*) filter (where bylib) as superseded_by_library, count(*) filter (where not bylib) as superseded_same_key from f),
(select count(*) filter (where bare) as unknown_severity, count(*) filter (where held and not bare) as stig_rules, count(*) filter (where not held and not bare) as rule_id_collisions from h)""")
def build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the build of the benchmarks counts while it writes its tables, on a document for each order."""
    built = build.benchmark_tables(_benchmarks(spark, sf_dir))
    built.meter.release()
    names = ("stig_files", "unreadable", "skipped_draft", "skipped_srg", "stigs", "superseded_by_newer_major", "superseded_by_library", "superseded_same_key", "unknown_severity", "stig_rules", "rule_id_collisions")
    return spark.createDataFrame([tuple(built.counters[n] for n in names)], ", ".join(f"{n} long" for n in names))


_CLAIMS = """with o as (select o_orderkey as k, 'C' || (o_custkey % 10) as pub, year(o_orderdate)::varchar as ver, o_custkey, o_custkey::varchar as artifact, o_orderstatus = 'F' as lib, strftime(o_orderdate, '%Y-%m-%d') as dated,
    case when o_orderkey % 3 = 0 then 'third' when o_orderkey % 3 = 1 then 'other' end as part, list(distinct l_partkey) as parts from orders join lineitem on l_orderkey = o_orderkey group by all),
p as (select a.pub, a.ver, min((a.k, b.k)) as ks from o a join o b on a.pub = b.pub and a.ver = b.ver and a.o_custkey = b.o_custkey and a.k < b.k and not list_has_any(a.parts, b.parts) group by 1, 2),
q as (select o.*, struct_extract_at(ks, 1) as ka, struct_extract_at(ks, 2) as kb from o left join p using (pub, ver)),
v as (select q.pub, q.ver, max(part) filter (where k = ka) as pa, max(part) filter (where k = kb) as pb from q group by 1, 2),
d as (select q.*, case when ka is null then 'single' when substr(pub, 2)::int >= 5 or pa is null or pb is null then 'unmapped' when pa = pb then 'occupied' else 'split' end as verdict from q join v using (pub, ver)),
f as (select *, case when verdict <> 'split' then pub when part is not null then pub || '_' || part end as final, verdict = 'split' and k in (ka, kb) as half from d),
g as (select *, row_number() over (partition by final, ver order by not half, k) as seq, row_number() over (partition by final, ver order by lib desc, dated desc, artifact desc, not half, k) = 1 and final is not null as kept from f)"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: what a customer ordered in a year claims one of ten ids, with the parts as rules."""
    rules = t(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("rules"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus").repartition("o_orderkey").distinct()
    docs = orders.join(rules, F.col("l_orderkey") == F.col("o_orderkey"))
    path = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "third/").when(F.col("o_orderkey") % 3 == 1, "other/").otherwise("-/"), F.col("o_orderkey").cast("string"))
    docs = docs.select(
        F.concat(F.lit("C"), (F.col("o_custkey") % 10).cast("string")).alias("stig_id"), F.year("o_orderdate").cast("string").alias("version"), F.col("o_orderkey").alias("arrival"), F.col("o_custkey").cast("string").alias("artifact"),
        F.lit(1).alias("release"), (F.col("o_orderstatus") == "F").alias("is_library"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("status_date"), path.alias("path"), "rules")
    return stored(docs, "claims")  # looked at several times


_CLAIMED = {f"C{k}": [("third/", f"C{k}_third"), ("other/", f"C{k}_other")] for k in range(5)}


@query(_CLAIMS + """select k as o_orderkey, pub as published, ver as version, verdict, final as stig_id, kept from g""")
def corrected_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two documents of an id, artifact and release that share no rule part the id; all others follow or are discarded."""
    found = arbitration.settled(_claims(spark, sf_dir), _CLAIMED)
    docs = found.documents.join(stored(found.winners.select("arrival", F.lit(True).alias("kept")), "winners"), "arrival", "left")
    return docs.select(F.col("arrival").alias("o_orderkey"), F.col("stig_id").alias("published"), "version", "verdict", F.col("final_id").alias("stig_id"), F.coalesce("kept", F.lit(False)).alias("kept"))


@query(_CLAIMS + """, l as (select *, (lib, dated, artifact, -seq) as own, max((lib, dated, artifact, -seq)) over (partition by final, ver order by seq rows between unbounded preceding and 1 preceding) as lead from g where final is not null),
x as (select *, struct_extract_at(greatest(own, lead), 1) as by_lib, struct_extract_at(least(own, lead), 1) as who_lib from l where lead is not null),
n as (select final, ver, count(*) filter (where by_lib and not who_lib) as superseded_by_library, count(*) filter (where not (by_lib and not who_lib)) as superseded_same_key from x group by 1, 2)
select final as stig_id, ver as version, max(k) filter (where kept) as winner, coalesce(any_value(superseded_by_library), 0) as superseded_by_library, coalesce(any_value(superseded_same_key), 0) as superseded_same_key, 0::bigint as differs
from g left join n using (final, ver) where final is not null group by 1, 2""")
def arbitration_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arbitration replayed event by event, and how often the plan differs from it."""
    docs = _claims(spark, sf_dir)
    told = stored(arbitration.tallied(arbitration.replayed(docs, _CLAIMED)), "replay")
    differs = arbitration.differing(arbitration.settled(docs, _CLAIMED), told).groupBy("final_id", "version").agg(F.count("*").alias("differs"))
    return told.join(differs, ["final_id", "version"], "left").na.fill(0, ["differs"]).withColumnRenamed("final_id", "stig_id")


@query("""with o as (select 'orders' as name, 'o_custkey:bigint:' || coalesce(length(o_custkey::varchar) || '=' || o_custkey, '-') || ';o_orderkey:bigint:' || length(o_orderkey::varchar) || '=' || o_orderkey || ';o_orderpriority:string:' || coalesce(length(o_orderpriority) || '=' || o_orderpriority, '-') || ';o_orderstatus:string:' || coalesce(length(o_orderstatus) || '=' || o_orderstatus, '-') || ';' as r from orders),
d as (select 'documents', 'doc_id:bigint:' || length(doc_id::varchar) || '=' || doc_id || ';lang:string:' || coalesce(length(lang) || '=' || lang, '-') || ';text:string:' || coalesce(length(text) || '=' || text, '-') || ';' from documents),
h as (select name, sha256(r) as h from (select * from o union all select * from d)),
n as (select name, ('0x' || substr(h, 31, 8))::bigint % 64 as part, ('0x' || substr(h, 1, 15))::bigint as a, ('0x' || substr(h, 16, 15))::bigint as b from h)
select name, part::int as part, count(*) as rows, sum(a)::varchar as a, sum(b)::varchar as b from n group by 1, 2""")
def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sums of a digest that no order, file or partitioning changes."""
    orders = t(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority").repartition(5)
    docs = t(spark, sf_dir, "documents").select("text", "lang", "doc_id")
    found = digest.parts(orders).withColumn("name", F.lit("orders")).unionByName(digest.parts(docs).withColumn("name", F.lit("documents")))
    return found.select("name", "part", "rows", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))


@query("""select o_orderkey, o_orderstatus, 'one' as side, 1::bigint as times from orders where o_orderkey % 100 = 7 union all select o_orderkey, 'X', 'other', 1 from orders where o_orderkey % 100 = 7 union all select o_orderkey, o_orderstatus, 'other', 2 from orders where o_orderkey % 1000 = 11""")
def digest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed and repeated rows, found in the parts whose sums differ."""
    one = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    changed = one.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 100 == 7, "X").otherwise(F.col("o_orderstatus")))
    more = one.filter("o_orderkey % 1000 = 11")
    return digest.differing(one, changed.unionByName(more).unionByName(more).repartition(3))


@query("""with m as (select distinct l_partkey as p, l_suppkey as c from lineitem), e as (select p_partkey as p, p_partkey + 1 as q from part where p_partkey % 10 = 4),
up as (select coalesce(q, m.p) as p, c, q is not null as moved from m left join e on m.p = e.p), down as (select distinct coalesce(q, m.p) as p, c from m left join e on m.p = e.p where c % 10 = 0),
u as (select * from up where (p, c) not in (select (p, c) from down)), a as (select coalesce(q, s.p) as p, c, q is not null as moved from (select p, c from m where c % 25 = 0) s left join e on s.p = e.p)
select p, c, src, bool_and(moved) as remapped from (select p, c, moved, 'ctid' as src from u union all select p, c, moved, 'override' from a) group by 1, 2, 3""".replace("(p, c) not in (select (p, c) from down)", "not exists (select 1 from down d where d.p = up.p and d.c = up.c)"))
def effective_pairs_of_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream pairs moved along redirects, less tombstones, and own pairs, as the build makes them."""
    pairs = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("technique_id"), F.col("l_suppkey").alias("control_id")).distinct()
    ends = t(spark, sf_dir, "part").filter("p_partkey % 10 = 4").select(F.col("p_partkey").alias("revoked_id"), (F.col("p_partkey") + 1).alias("replacement_id"))
    found = build.effective_pairs(pairs, pairs.filter("control_id % 25 = 0"), pairs.filter("control_id % 10 = 0"), ends)
    return found.select(F.col("technique_id").alias("p"), F.col("control_id").alias("c"), F.col("source").alias("src"), "remapped")


_META = """with m as (select case n_nationkey when 3 then 'stig_library' when 5 then 'attack' when 7 then 'ctid_attack_version' when 9 then 'ctid_attack_release' else lower(n_name) end as name, (1990 + n_nationkey)::varchar || '-06-01' as version, n_name as artifact from nation)"""


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    name = F.when(k == 3, "stig_library").when(k == 5, "attack").when(k == 7, "ctid_attack_version").when(k == 9, "ctid_attack_release").otherwise(F.lower("n_name"))
    return t(spark, sf_dir, "nation").select(name.alias("source_name"), F.concat((k + 1990).cast("string"), F.lit("-06-01")).alias("source_version"), F.col("n_name").alias("artifact"))


@query(_META + """select o_orderkey, (select artifact from m where name = 'stig_library') as library, case when o_orderpriority = '5-LOW' then 'deprecated' when o_orderstatus = 'F' then null when o_orderstatus = 'P' then 'sunset' else 'local' end as currency from orders""")
def benchmark_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13: why a benchmark may not be the library's current guidance, on every order."""
    origin = F.when(F.col("o_orderstatus") == "F", "library").when(F.col("o_orderstatus") == "P", "sunset").otherwise("loose")
    stigs = t(spark, sf_dir, "orders").select("o_orderkey", origin.alias("origin"), F.when(F.col("o_orderpriority") == "5-LOW", "deprecated").alias("xccdf_status"))
    return notes.provenance(stigs, _meta(spark, sf_dir)).select("o_orderkey", "library", "currency")


@query(_META + """, p as (select p_partkey, case when p_size % 5 <> 0 then (1980 + p_size)::varchar || '-01-01' end as created, case p_size % 3 when 0 then 'mapped' when 1 then 'non_mappable' else 'absent' end as status from part
where not exists (select 1 from lineitem where l_partkey = p_partkey and p_partkey % 4 <> 0 and l_returnflag = 'R' and l_linestatus = 'F'))
select p_partkey, mapped_for, case when status = 'mapped' then 'suppressed' when status = 'non_mappable' then 'reviewed' when created > mapped_on then 'newer' when created is not null then 'uncovered' else 'undated' end as reason
from p, (select max(version) filter (where name = 'ctid_attack_version') as mapped_for, max(version) filter (where name = 'ctid_attack_release') as mapped_on from m)""")
def uncontrolled_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a technique has no effective control, on every part."""
    size = F.col("p_size")
    status = F.when(size % 3 == 0, "mapped").when(size % 3 == 1, "non_mappable").otherwise("absent")
    techniques = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("technique_id"), F.when(size % 5 != 0, F.concat((size + 1980).cast("string"), F.lit("-01-01"))).alias("created"), status.alias("ctid_status"))
    used = (F.col("l_partkey") % 4 != 0) & (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    pairs = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("technique_id"), (~used).alias("suppressed"))
    return notes.uncontrolled(techniques, pairs, _meta(spark, sf_dir)).select(F.col("technique_id").alias("p_partkey"), "mapped_for", "reason")


_GOVERNED = [("small", "(?i)^small", r"(?P<n>\d+)", [(9, "11"), (5, "7"), (1, "77"), (0, None)]), ("any", "(?i)brass$", r"(?P<n>\d+)", [(0, "3")]), ("idle", "^Nothing is named so", r"(?P<n>\d+)", [(0, "1")])]


@query("""with s as (select p_type as id, p_size::varchar as version from part), e(entry, pattern, named) as (values ('small', '(?i)^small', ['11', '7', '77']), ('any', '(?i)brass$', ['3']), ('idle', '^Nothing is named so', ['1'])),
g as (select entry, version, count(*) as n from s, e where regexp_matches(id, pattern) group by 1, 2), w as (select entry, unnest(named) as version from e)
select entry, version, 'unmapped' as finding, n as stig_rows from g where (entry, version) not in (select (entry, version) from w)
union all select entry, version, 'absent', 0 from w where (entry, version) not in (select (entry, version) from g) and entry in (select entry from g)
union all select entry, null, 'idle', 0 from e where entry not in (select entry from g)""")
def rule_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of builds held against the benchmarks that they govern, on every part."""
    return build.drift(t(spark, sf_dir, "part").select(F.col("p_type").alias("stig_id"), F.col("p_size").cast("string").alias("version")), _GOVERNED)


# --- bundles


def _bundle_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles in JSON: one of each part (an attack-pattern), supplier (an intrusion-set, or a mitigation where the key is odd), and order
    (relationships that its lines make). Some parts are sub-techniques, some revoked, and some suppliers deprecated."""
    ref = lambda i: F.array(F.struct(F.lit("elsewhere").alias("source_name"), F.lit("X").alias("external_id")), F.struct(F.lit("mitre-attack").alias("source_name"), i.alias("external_id")))
    k, sub = F.col("p_partkey"), F.col("p_partkey") % 7 == 0
    number = F.when(sub, F.concat(((k / 7).cast("long") * 3).cast("string"), F.lit("."), k.cast("string"))).otherwise(k.cast("string"))
    phases = F.array(F.struct(F.lit("mitre-attack").alias("kill_chain_name"), F.lower("p_brand").alias("phase_name")), F.struct(F.lit("other").alias("kill_chain_name"), F.lit("no").alias("phase_name")))
    part = F.struct(F.lit("attack-pattern").alias("type"), F.concat(F.lit("p"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), (k % 10 == 4).alias("revoked"), ref(F.concat(F.lit("T"), number)).alias("external_references"), phases.alias("kill_chain_phases"), sub.alias("x_mitre_is_subtechnique"), F.lit("2020-02-03T00:00:00Z").alias("created"))
    s = F.col("s_suppkey")
    odd = s % 2 == 1
    supplier = F.struct(F.when(odd, "course-of-action").otherwise("intrusion-set").alias("type"), F.concat(F.lit("s"), s.cast("string")).alias("id"), F.col("s_name").alias("name"), (s % 5 == 0).alias("x_mitre_deprecated"), ref(F.concat(F.when(odd, F.when(s % 9 == 0, "T").otherwise("M")).otherwise("G"), s.cast("string"))).alias("external_references"), F.array("s_name", F.lit("also")).alias("aliases"))
    l_odd = F.col("l_suppkey") % 2 == 1
    edge = F.struct(F.lit("relationship").alias("type"), F.when(l_odd, "mitigates").otherwise("uses").alias("relationship_type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_ref"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_ref"))
    text = lambda objects: F.to_json(F.struct(objects.alias("objects"))).alias("content")
    parts, suppliers = t(spark, sf_dir, "part").select(text(F.array(part))), t(spark, sf_dir, "supplier").select(text(F.array(supplier)))
    return parts.unionByName(suppliers).unionByName(t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(text(F.collect_list(edge))).select("content"))


_PARTS = """with p as (select p_partkey, p_name, p_brand, p_partkey % 7 = 0 as sub, p_partkey % 10 = 4 as gone, 'T' || case when p_partkey % 7 = 0 then ((p_partkey // 7) * 3)::varchar || '.' || p_partkey else p_partkey::varchar end as id from part)"""


@query(_PARTS + """, s as (select s_suppkey as k, case when s_suppkey % 2 = 1 then case when s_suppkey % 9 = 0 then 'T' else 'M' end else 'G' end || s_suppkey as id, s_suppkey % 5 = 0 as gone from supplier)
select distinct case when k % 2 = 1 then 'mitigates' else 'uses' end as edge, s.id as source, p.id as technique from lineitem join p on p_partkey = l_partkey join s on k = l_suppkey where not p.gone and not s.gone and s.id not like 'T%'""")
def bundle_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles in JSON, read again; who uses and what mitigates which live technique."""
    found = build.attack_edges(documents.bundles(_bundle_texts(spark, sf_dir), "content"))
    uses = found["uses"].select(F.lit("uses").alias("edge"), F.col("actor_id").alias("source"), F.col("technique_id").alias("technique"))
    return uses.unionByName(found["mitigates"].select(F.lit("mitigates").alias("edge"), F.col("mitigation_id").alias("source"), F.col("technique_id").alias("technique"))).distinct()


@query(_PARTS + """select id, p_name as name, sub, case when sub and exists (select 1 from p q where q.id = split_part(p.id, '.', 1) and not q.gone) then split_part(id, '.', 1) end as parent, lower(p_brand) as tactics, '2020-02-03' as created from p where not gone""")
def bundle_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live techniques of bundles in JSON, parents that aren't live taken out."""
    live = build.live_techniques(documents.bundles(_bundle_texts(spark, sf_dir), "content"), F.lit(None).cast("string"))
    return live.select(F.col("technique_id").alias("id"), "name", F.col("is_subtechnique").alias("sub"), F.col("parent_id").alias("parent"), joined("tactics").alias("tactics"), "created")


# --- sweeps of a corpus


@query("""with d as (select p_partkey as k, (p_size % 9 + 1)::varchar as d from part) select 'P' || k as stig_id, '0' || d as padded from d where k % 4 <> 2""")
def padded_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that write a version with a leading zero other than as a minor, on every part."""
    k, d = F.col("p_partkey"), (F.col("p_size") % 9 + 1).cast("string")
    title = F.when(k % 4 == 0, F.concat(F.lit("Gadget 0"), d)).when(k % 4 == 1, F.concat(F.lit("Gadget v0"), d)).when(k % 4 == 2, F.concat(F.lit("Gadget 14.0"), d)).otherwise(F.concat(F.lit("Gadget 0"), d, F.lit(" Kit 14.0"), d))
    stigs = t(spark, sf_dir, "part").select(F.concat(F.lit("P"), k.cast("string")).alias("stig_id"), F.lit("1").alias("version"), title.alias("title"), F.lit("").alias("product_keywords"))
    return conformance.padded_versions(stigs).select("stig_id", joined("padded").alias("padded"))


@query("""with d as (select o_orderkey as k, o_orderkey % 13 = 0 as broken, o_orderstatus = 'P' as silent, o_orderpriority = '5-LOW' as odd from orders)
select 'error' as severity, printf('%010d', k) as name, 'can''t be read' as message from d where broken
union all select 'error', 'B' || k, 'says no release, in ' || printf('%010d', k) from d where not broken and silent
union all select 'warning', 'B' || k, 'has no label of version and release but ' || chr(39) || case when silent then '' else 'Release: 4' end || chr(39) from d where not broken and (silent or odd)""")
def parse_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order, parsed; what can't be read, says no release or has no label."""
    k = F.col("o_orderkey")
    info = F.when(F.col("o_orderstatus") == "P", " ").otherwise("Release: 4")
    text = F.concat(F.lit('<Benchmark id="B'), k.cast("string"), F.lit('"><title>T</title><plain-text id="release-info">'), info, F.lit("</plain-text><version>"), F.when(F.col("o_orderpriority") == "5-LOW", "one").otherwise("1"), F.lit("</version>"), F.when(k % 13 == 0, "").otherwise("</Benchmark>"))
    files = t(spark, sf_dir, "orders").select(F.format_string("%010d", k).alias("source_document"), text.alias("content"))
    return conformance.parse_findings(documents.benchmarks(files)).drop("phase")


# --- archives and listings


@query("""with f as (select source || '.txt' as base, sha256(coalesce(text, '')) as sha256, min(printf('%08d', doc_id) || '/' || source || '.txt') as d from documents group by 1, 2),
n as (select *, row_number() over (partition by base order by d, sha256) as n from f) select case when n > 1 then n || '_' || base else base end as name, sha256 from n""")
def loose_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loose files to write, the same basename and content once, other content numbered."""
    docs = t(spark, sf_dir, "documents")
    rows = docs.select(F.format_string("%08d/%s.txt", "doc_id", "source").alias("source_document"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return archives.extracted(rows).select("name", "sha256")


@query("""select doc_id, sha1('blob ' || strlen(text) || chr(0) || text) as sha from documents where text is not null""")
def git_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id under which a listing names a file's content."""
    return t(spark, sf_dir, "documents").filter("text is not null").select("doc_id", ids.git_blob_sha(F.col("text").cast("binary")).alias("sha"))


_ZIPS = """with z as (select 'U_P' || s_nationkey || case when s_suppkey % 5 = 4 then '_STIG.zip' when s_suppkey % 2 = 0 then '_V' || (s_suppkey % 7) || 'R' || (s_suppkey % 11) || '_STIG.zip' else printf('_Y%02dM%02d_STIG.zip', 20 + s_suppkey % 6, 1 + s_suppkey % 12) end as name,
s_nationkey as n, case when s_suppkey % 5 = 4 then null else s_suppkey % 2 end as scheme, case when s_suppkey % 2 = 0 then s_suppkey % 7 else 20 + s_suppkey % 6 end as a, case when s_suppkey % 2 = 0 then s_suppkey % 11 else 1 + s_suppkey % 12 end as b from supplier)"""


@query(_ZIPS + " select distinct name from z where scheme is null union select name from z where scheme is not null qualify (a, b) = max((a, b)) over (partition by n, scheme)")
def newest_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest release of each product and scheme out of a published listing."""
    k = F.col("s_suppkey")
    ending = F.when(k % 5 == 4, "_STIG.zip").when(k % 2 == 0, F.format_string("_V%dR%d_STIG.zip", k % 7, k % 11)).otherwise(F.format_string("_Y%02dM%02d_STIG.zip", 20 + k % 6, 1 + k % 12))
    zips = t(spark, sf_dir, "supplier").select(F.concat(F.lit("U_P"), F.col("s_nationkey").cast("string"), ending).alias("name"))
    return archives.newest_per_product(zips).distinct()


@query("""select 'U_SRG-STIG_Library_' || strftime(max(o_orderdate), '%B_%Y') || '.zip' as name from orders""")
def newest_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest library of a listing that holds one for each order's month, and sunset ones that never count."""
    months = t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "MMMM_yyyy").alias("m")).distinct()
    zips = months.select(F.concat(F.lit("U_SRG-STIG_Library_"), "m", F.lit(".zip")).alias("name"))
    sunset = spark.createDataFrame([("U_SRG-STIG_Sunset_Compilation_Library_July_2090.zip",)], "name string")
    return spark.createDataFrame([(archives.newest_library(zips.unionByName(sunset)),)], "name string")


# --- currency


@query("""select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem group by 1 having count(*) = 4) and exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def unchanged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose length is the recorded one; records without a length never match."""
    present = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("length"))
    recorded = t(spark, sf_dir, "orders").select("o_orderkey", F.lit(4).cast("long").alias("length"))
    return changes.unchanged(present, recorded, "o_orderkey", "length").select("o_orderkey")


@query("""select s_suppkey, case when s_suppkey % 11 = 0 then 'skip' when s_suppkey % 5 = 0 then 'ingest' when s_suppkey % 3 = s_nationkey % 3 then 'none' else 'refresh' end as action from supplier""")
def source_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do for each source; one that can't be read holds no other up."""
    k = F.col("s_suppkey")
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 5 != 0, (k % 3).cast("string")).alias("recorded"), (F.col("s_nationkey") % 3).cast("string").alias("published"), F.when(k % 11 == 0, "unreadable").alias("problem"))
    return changes.actions(rows).select("s_suppkey", "action")


@query("""with o as (select 'f' || o_custkey % 700 as name, o_orderdate::date::varchar as date, o_orderkey as seq, case when o_orderkey % 5 = 0 then null else o_custkey end as on_disk_bytes, o_orderstatus = 'P' as removed from orders
where o_orderkey % 13 <> 0 and o_orderkey % 11 <> 0), l as (select *, row_number() over (partition by name order by seq desc) as k from o)
select name, date, seq, on_disk_bytes from l where k = 1 and not removed""")
def manifest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest's lines, some cut and some naming other folders, as the latest state of each name."""
    o = t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 11 == 0, "../f").otherwise("f"), (F.col("o_custkey") % 700).cast("string"))
    line = F.to_json(F.struct(name.alias("name"), F.to_date("o_orderdate").cast("string").alias("date"), F.when(k % 5 != 0, F.col("o_custkey")).alias("on_disk_bytes"), (F.col("o_orderstatus") == "P").alias("removed"), k.alias("at")))
    rows, _ = manifest.parsed(o.select(F.when(k % 13 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")))
    return manifest.latest(rows).select("name", "date", F.col("at").alias("seq"), "on_disk_bytes")


# --- the resolver

_ASKED = {0: "red widget, blue bolt", 1: "hot gear and ring", 2: "zzz"}
_MET = """with p as (select p_partkey, string_split(p_name, ' ') || [lower(p_type)] as raw from part), n as (select count(*) as n from part),
doc as (select p_partkey, list_distinct(raw) as toks from p), df as (select token, count(*) as df from (select unnest(toks) as token from doc) group by 1),
frag(r, pos, toks) as (values (0, 0, ['red', 'widget']), (0, 1, ['blue', 'bolt']), (1, 0, ['hot', 'gear']), (1, 1, ['ring'])),
w as (select r, pos, token, coalesce(ln((n + 1) / (df + 1)) + 1, 1.0) as idf, coalesce(df, 0) <= 0.05 * n as rare from (select r, pos, unnest(toks) as token from frag) left join df using (token), n),
s as (select r, pos, p_partkey, len(toks) as size, sum(case when list_contains(toks, token) then 1 else 0 end) as met, round(100 * (0.8 * sum(case when list_contains(toks, token) then idf else 0 end) / sum(idf) + 0.2), 9) as score,
      bool_or(rare) and bool_and(list_contains(toks, token) or not rare) as sure from doc, w group by 1, 2, 3, 4),
best as (select * from s where met > 0 and score >= 10 qualify row_number() over (partition by r, p_partkey order by score desc, pos) = 1),
top as (select *, sure and max(score) over (partition by r) - score <= 1e-9 as high from best),
placed as (select *, row_number() over (partition by r order by score desc, not high, size - met, 'P' || p_partkey) as place from top), cut as (select r, score as c from placed where place = 5)"""


def _stigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    return part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("stig_id"), F.lit("x").alias("version"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.lit(None).cast("string").alias("product_keywords"), F.lit("library").alias("origin"))


@query(_MET + " select r as request, 'P' || p_partkey as stig_id, score, high as high_confidence, place::int as place, (select count(*) from placed q where q.r = placed.r and q.place > 5 and abs(q.score - c) <= 1e-9) as tied_omitted from placed join cut using (r) where place <= 5")
def resolved_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions to the best benchmarks, fragments, idf coverage, ranks and ties."""
    asked = spark.createDataFrame(list(_ASKED.items()), "request long, description string")
    hits, _ = resolver.resolve(_stigs(spark, sf_dir), asked)
    return hits.select(F.col("request").cast("int").alias("request"), "stig_id", "score", "high_confidence", F.col("place").cast("int").alias("place"), "tied_omitted")


@query("""select (p_partkey % 3)::int as request, 'P' || p_partkey as stig_id, 100.0::double as score, 'alias:odd thing' as matched_on, case when p_partkey % 2 = 0 then 'scoped' else 'superseded-major' end as reason, p_partkey % 2 = 0 as applicable
from part where p_partkey in (3, 6) and p_partkey % 3 = 0""")
def resolved_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias is a score of 100, and a build in the description tells the version that applies."""
    stigs = _stigs(spark, sf_dir).withColumn("version", F.when(F.substring(F.col("stig_id"), 2, 9).cast("int") % 2 == 0, "x").otherwise("y"))
    rules = resolver.Rules({"P3": ["odd thing"], "P6": ["other", "odd thing"]}, [("parts", "^P[0-9]+$", r"build (?P<n>[0-9]+)", [(0, "y"), (900, "x")])])
    hits, _ = resolver.resolve(stigs, spark.createDataFrame([(0, "odd thing build 950")], "request long, description string"), rules)
    return hits.filter("score = 100").select(F.col("request").cast("int").alias("request"), "stig_id", "score", "matched_on", "reason", "applicable")


# --- questions: the driver's tables in the knowledge base's shape


def _kb(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def of(name: str, *columns: str) -> DataFrame:
        return t(spark, sf_dir, name).selectExpr(*columns)

    return {
        "techniques": of("supplier", "'T' || s_suppkey as technique_id", "s_name as name", "array('n' || s_nationkey) as tactics", "'mapped' as ctid_status"),
        "revoked_technique": of("customer", "'T9' || c_custkey as revoked_id", "'T' || (c_custkey % 10) as replacement_id", "c_name as revoked_name", "'1' as source_version"),
        "controls": of("nation", "'AC-' || (n_nationkey + 1) as control_id", "n_name as name", "'AC' as family"),
        "technique_control": of("supplier", "'T' || s_suppkey as technique_id", "'AC-' || (s_nationkey + 1) as control_id", "'ctid' as source", "false as suppressed"),
        "cci_control": of("nation", "'CCI-' || n_nationkey as cci_id", "'AC-' || (n_nationkey + 1) as control_id"),
        "rule_cci": of("part", "'R' || p_partkey as rule_id", "'CCI-' || (p_partkey % 25) as cci_id"),
        "stigs": of("part", "p_brand as stig_id", "'1' as version", "p_brand || ' guide' as title", "'V1R1' as release_label", "'library' as origin", "lower(p_brand) as product_keywords").distinct(),
        "stig_rules": of("part", "'R' || p_partkey as rule_id", "'V' || p_partkey as group_id", "p_brand as stig_id", "'1' as stig_version", "case p_size % 3 when 0 then 'I' when 1 then 'II' else 'III' end as severity_cat", "'x' as severity_level", "p_name as title"),
        "actors": of("region", "'G' || r_regionkey as actor_id", "r_name as name", "array(lower(r_name) || ' group ', '') as aliases"),
        "actor_technique": of("supplier", "'G' || (s_nationkey % 5) as actor_id", "'T' || s_suppkey as technique_id"),
        "mitigations": of("nation", "'M' || n_nationkey as mitigation_id", "n_name as name", "'d' as description"),
        "technique_mitigation": of("supplier", "'T' || s_suppkey as technique_id", "'M' || s_nationkey as mitigation_id", "s_name as description"),
        "detection_strategies": of("supplier", "'DET' || s_suppkey as detection_strategy_id", "'T' || s_suppkey as technique_id", "s_name as name"),
        "analytics": of("customer", "'AN' || c_custkey as analytic_id", "'DET' || (c_custkey % 10) as detection_strategy_id", "c_name as name", "'d' as description", "array(c_mktsegment) as platforms", "'[]' as mutable_elements"),
        "analytic_log_sources": of("customer", "'AN' || c_custkey as analytic_id", "'l' || (c_nationkey % 3) as name", "'c' as channel", "'DC1' as data_component_id"),
        "data_components": spark.createDataFrame([("DC1", "component")], "data_component_id string, name string"),
        "ingest_meta": spark.createDataFrame([("attack", "19.2"), ("ctid", "1.0"), ("stig:a:1", "x")], "source_name string, source_version string"),
    }


@query("select distinct p_brand as stig_id, '1' as version, p_brand || ' guide' as title, 'V1R1' as release_label, 'library' as origin from part where lower(p_brand) like '%d#1%'")
def stig_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmarks whose title, id or keywords hold a term."""
    found = questions.list_stigs(_kb(spark, sf_dir), "D#1")
    return spark.createDataFrame(found, "stig_id string, version string, title string, release_label string, origin string")


@query("""with d as (select s_suppkey as k, case when lower(s_name) = 'supplier#000000007' then 100 else 60 end as score, null as redirected_from from supplier where s_name ilike '%SUPPLIER#000000007%'
union all select c_custkey % 10, 50, 'T9' || c_custkey from customer where c_name ilike '%SUPPLIER#000000007%' and c_custkey % 10 in (select s_suppkey from supplier))
select 'T' || k as technique_id, score::int as score from d union all select 'T' || k, 50 from (select distinct c_custkey % 10 as k from customer where c_name ilike '%SUPPLIER#00000000%' and false)""")
def technique_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live and revoked names that hold a text, each technique's best hit."""
    found = questions.search_techniques(_kb(spark, sf_dir), "SUPPLIER#000000007")
    return spark.createDataFrame([(r["technique_id"], r["score"]) for r in found], "technique_id string, score int")


@query("""select 'R' || p_partkey as rule_id, p_brand as stig_id, case p_size % 3 when 0 then 'I' when 1 then 'II' else 'III' end as cat, 'CCI-' || (p_partkey % 25) as ccis, p_brand || ' guide' as stig_title from part where p_partkey in (3, 7, 11, 12)
union all select 'not found', 'R99999999', null, null, null""")
def finding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule or group id, cases aside, with their benchmark and CCIs, and what isn't there."""
    found = questions.finding_details(_kb(spark, sf_dir), ["r3", "V7", "R11", "v12", "R3", "R99999999"])
    rows = [(r["rule_id"], r["stig_id"], r["severity_cat"], ",".join(r["ccis"]), r["stig_title"]) for r in found["findings"]]
    return spark.createDataFrame([*rows, *[("not found", i, None, None, None) for i in found["not_found"]]], "rule_id string, stig_id string, cat string, ccis string, stig_title string")


@query("""select 'T' || s_suppkey as technique_id, s_name as name, 'n' || s_nationkey as tactics from supplier where s_nationkey % 5 = 2""")
def actor_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The techniques of an actor named by an alias in other case."""
    kb = _kb(spark, sf_dir)
    name = t(spark, sf_dir, "region").filter("r_regionkey = 2").first().r_name
    found = questions.techniques_for_actor(kb, f"  {name.upper()} Group")
    return spark.createDataFrame([(r["technique_id"], r["name"], ",".join(r["tactics"])) for r in found["techniques"]], "technique_id string, name string, tactics string")


@query("""with s as (select s_nationkey as n from supplier where s_suppkey = 3), f as (select case p_size % 3 when 0 then 'I' else 'II' end as cat from part, s where p_brand in ('Brand#1', 'Brand#2', 'Brand#3') and p_size % 3 < 2 and p_partkey % 25 = n),
a as (select * from customer where c_custkey % 10 = 3), seg as (select min(c_mktsegment) as m from customer)
select 'findings' as what, count(*) as n from f union all select 'cat ' || cat, count(*) from f group by 1 union all select 'analytics', count(*) from a union all select 'applicable', count(*) from a, seg where c_mktsegment = m
union all select 'detectable', count(*) from a, seg where c_mktsegment = m and c_nationkey % 3 = 1 union all select 'mitigations', 1 union all select 'controls', 1""")
def technique_defenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A technique's findings in scope, mitigations and analytics, counted."""
    kb = _kb(spark, sf_dir)
    platform = t(spark, sf_dir, "customer").agg(F.min("c_mktsegment")).first()[0]
    s = questions.defenses_for_technique(kb, "T3", benchmark_ids=["Brand#1", "Brand#2", "Brand#3"], severity=["I", "II"], platforms=[platform.lower()], log_sources=["l1"])["summary"]
    rows = [("findings", s["findings"]), *[(f"cat {c}", n) for c, n in s["by_cat"].items()], *[(k, s[k]) for k in ("analytics", "applicable", "detectable", "mitigations")], ("controls", s["control_counts"]["mapped"])]
    return spark.createDataFrame(rows, "what string, n long")


@query("""select 'M3' as id, n_name as name, (select count(*) from supplier where s_nationkey = 3) as n from nation where n_nationkey = 3 union all select 'DET4', s_name, (select count(*) from customer where c_custkey % 10 = 4) from supplier where s_suppkey = 4
union all select 'AN5', c_name, 1 from customer where c_custkey = 5 union all select 'X1', null, null""")
def defense_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mitigations, strategies with their analytics, and analytics with log sources, by the shape of their ids."""
    found = questions.defense_details(_kb(spark, sf_dir), ["m3", "DET4", "AN5", "X1"])
    rows = [(m["mitigation_id"], m["name"], m["technique_count"]) for m in found["mitigations"]] + [(s["detection_strategy_id"], s["name"], len(s["analytics"])) for s in found["detection_strategies"]]
    rows += [(a["analytic_id"], a["name"], len(a["log_sources"])) for a in found["analytics"]] + [(i, None, None) for i in found["not_found"]]
    return spark.createDataFrame(rows, "id string, name string, n long")


@query("""select o_orderkey as source, case when o_orderkey % 9 = 0 or o_custkey % 8 = 0 then case when o_orderkey % 9 = 0 and o_custkey % 8 = 0 then 'same' else 'incomparable' end
when (o_custkey % 7, o_orderkey % 12) < (o_custkey % 11, o_custkey % 3) then 'newer' when (o_custkey % 7, o_orderkey % 12) > (o_custkey % 11, o_custkey % 3) then 'older' else 'same' end as state from orders""")
def source_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded versions against published ones, some of them no numbers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pair = lambda a, b: F.concat_ws(".", a.cast("string"), b.cast("string"))
    stored, published = F.when(k % 9 == 0, "draft").otherwise(pair(c % 7, k % 12)), F.when(c % 8 == 0, "draft").otherwise(pair(c % 11, c % 3))
    return t(spark, sf_dir, "orders").select(k.alias("source"), currency.state(stored, published).alias("state"))


@query("""with r as (select 'kb-' || (date '2024-01-01' + (p_partkey % 9000)::int)::varchar as tag, 5 + p_size % 3 as schema, 's' || p_partkey as sha, p_size as a, p_partkey % 50 as b from part),
best as (select schema, arg_max((tag, sha, a, b), (tag, sha)) as n from (select * from r) group by 1), tags as (select distinct tag from r),
i as (select c_custkey as host, 4 + c_custkey % 5 as schema, case when c_custkey % 7 <> 0 then 'h' || c_custkey end as sha, case when c_custkey % 14 = 0 then 'unreadable' end as problem,
 case when c_custkey % 7 <> 0 and c_custkey % 2 = 0 then 'kb-' || (date '2024-01-01' + (c_custkey * 37 % 9500)::int)::varchar end as release, c_nationkey * 2 as a, c_custkey % 50 as b from customer),
j as (select i.*, best.n, n[1] as newest, n[3] as na, n[4] as nb, (select arg_max(x.n[1], x.n[1]) from best x where x.schema > i.schema) as beyond, case when sha is null then coalesce('what is installed can''t be used: ' || problem, 'nothing is installed') end as unusable from i left join best on best.schema = i.schema),
k as (select *, case when newest is null and beyond is not null then 'upgrade_package' when newest is null and sha is null then 'build_locally' when newest is null then 'none' when sha is null then 'install'
 when release is not null then case when release < newest then 'install' else 'none' end when na > a or nb > b then 'install' else 'none' end as act,
 case when newest is null and beyond is not null then 'no release has schema ' || schema || '; ' || beyond || ' needs a newer package' when newest is null and sha is null then unusable || ', and no release has schema ' || schema
 when newest is null then 'no release has schema ' || schema || '; what is installed stays' when sha is null then unusable when release < newest then newest || ' is newer than ' || release
 when release is not null and release not in (select tag from tags) then release || ' is installed and no longer published; the newest is ' || newest when release is not null then release || ' is current'
 when na > a or nb > b then newest || ' has newer ' || case when na > a and nb > b then 'a, b' when na > a then 'a' else 'b' end || case when na < a then '; older, and would replace: a' when nb < b then '; older, and would replace: b' else '' end
 else 'the local build is as current as ' || newest end as why from j)
select host, release, newest, beyond, case when act = 'none' and beyond is not null then 'upgrade_package' else act end as action, why || case when act = 'none' and beyond is not null then '; ' || beyond || ' needs a newer package' else '' end as reason from k""")
def release_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of a fleet of installations should do about the published releases, and why."""
    k, day = F.col("c_custkey"), lambda n: F.concat(F.lit("kb-"), F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("string"))
    versions = lambda a, b: F.create_map(F.lit("a"), a.cast("string"), F.lit("b"), b.cast("string"))
    p = t(spark, sf_dir, "part")
    # Tags of one day are told apart by their digest here.
    releases = p.select(day(F.col("p_partkey") % 9000).alias("tag"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("date"), (5 + F.col("p_size") % 3).cast("int").alias("schema"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("sha256"), versions(F.col("p_size"), F.col("p_partkey") % 50).alias("sources"))
    releases = releases.withColumn("date", F.concat("tag", "date"))
    sha = F.when(k % 7 != 0, F.concat(F.lit("h"), k.cast("string")))
    hosts = t(spark, sf_dir, "customer").select(k.alias("host"), (4 + k % 5).cast("int").alias("schema"), sha.alias("sha256"), F.when(k % 14 == 0, "unreadable").alias("problem"), F.when(k % 2 == 0, sha).otherwise("other").alias("recorded_sha256"), day(k * 37 % 9500).alias("recorded_release"), versions(F.col("c_nationkey") * 2, k % 50).alias("sources"))
    return currency.decisions(hosts, releases).select("host", "release", "newest", "beyond", "action", "reason")
