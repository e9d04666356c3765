"""The registered queries of this subpackage: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import binary, bytepairs, fingerprint, language, lexical, media, neardup, packing, phrases, pieces, pii, sharding, urls
from tarnflow.llm.common import documents

SHARDS, SEED = 8, 20260
# The rules of the URL query (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detected(documents(spark, sf_dir)))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.linked(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprinted(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffled(documents(spark, sf_dir), SHARDS, SEED)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.indexed(documents(spark, sf_dir))
    found = lexical.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    index.drop()
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP11_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents where text is not null),
     sized as (select doc_id, terms, len(terms)::bigint as n from d where len(terms) > 0),
     total as (select count(*)::bigint as n_docs, sum(n)::bigint as length from sized),
     tf as (select doc_id, n, term, count(*)::bigint as tf from (select doc_id, n, unnest(terms) as term from sized) group by all),
     df as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, total group by term, n_docs),
     asked as (select item_id, term, count(*)::bigint as c from (
         select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
     scores as (
         select item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // length))))::bigint as score
         from asked join df using (term) join tf using (term), total group by item_id, doc_id),
     ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = bytepairs.encoded(docs, path, public_tokenizers.PATTERN).drop("text")
    both = bytepairs.decoded(ids, path)
    return both.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


OP13_SQL = r"""
with words as (
         select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^ \t]+') as w
         from documents where text is not null),
     places as (select lang, w, unnest(range(1, len(w) + 1)) as i from words where len(w) > 0),
     f1 as (select lang, w[i] as p, count(*) as f from places group by all),
     f2 as (select lang, w[i] as p1, w[i + 1] as p2, count(*) as f from places where i + 1 <= len(w) group by all),
     f3 as (select lang, w[i] as p1, w[i + 1] as p2, w[i + 2] as p3, count(*) as f from places where i + 2 <= len(w) group by all having count(*) >= 10),
     totals as (select lang, sum(f)::bigint as n from f1 group by lang),
     pairs as (
         select f2.lang, f2.p1, f2.p2, f2.f as a, h.f as l, t.f as r from f2 join f1 h on h.lang = f2.lang and h.p = f2.p1 join f1 t on t.lang = f2.lang and t.p = f2.p2 where f2.f >= 10),
     triples as (
         select f3.lang, f3.p1, f3.p2, f3.p3, f3.f as a, x.a as a12, x.l as a1, y.a as a23, y.r as a3
         from f3 join pairs x on x.lang = f3.lang and x.p1 = f3.p1 and x.p2 = f3.p2 join pairs y on y.lang = f3.lang and y.p1 = f3.p2 and y.p2 = f3.p3),
     covers as (
         select lang, p1, p2, max(a) as longer from (select lang, p1, p2, a from triples union all select lang, p2, p3, a from triples) group by all),
     scored as (
         select lang, p1 || ' ' || p2 as phrase, a, 1 as k, l, r from pairs left join covers using (lang, p1, p2) where longer is null or 100 * longer < 50 * a
         union all select lang, p1 || ' ' || p2 || ' ' || p3, a, 1, a1, a23 from triples
         union all select lang, p1 || ' ' || p2 || ' ' || p3, a, 2, a12, a3 from triples),
     exact as (select lang, phrase, a, k, l, r, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from scored),
     lowest as (select * from exact qualify row_number() over (partition by lang, phrase order by score, k) = 1),
     ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_pii, op3_sentencepiece, op4_url_filter, op5_packing, op6_near_dedup, op7_fingerprints, op8_sharding, op9_token_files, op10_media, op11_lexical_search, op12_byte_bpe, op13_phrases)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL of the searches and the phrases. The others can't be told in DuckDB's SQL whole (models, sketches, tokenizers, file formats,
    permutations); tests/llm holds each against a brute-force version, an exact round trip or held-out labels."""
    return {"op11_lexical_search": OP11_SQL, "op13_phrases": OP13_SQL}
