"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, knn, langid, licenses, media, mixing, ngram_join, packing, periods, phrases, sharding, warc
from .common import read

Query = Callable[[SparkSession, str], DataFrame]

#: Near-duplicate rule of the join query: 4 words, 85 of 100.
JOIN_RULE = ngram_join.Rule(4, 85, 100)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.flag_copies(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.summarise(chat.format_chats(chat.with_probe(read(spark, sf_dir, "conversations"))))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"), JOIN_RULE).drop("text_key")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, domains, fit = mixing.mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    best = F.expr("array_position(posterior, array_max(posterior))").cast("int")
    return mixed.select("doc_id", "tokens", F.element_at(F.array(*map(F.lit, domains)), best).alias("domain"), "posterior", "rate", F.lit(float(abs(fit.errors).max())).alias("largest_target_error"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))[1]


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.ring_shards(read(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op11_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(read(spark, sf_dir, "documents"), plant=True)


def queries() -> dict[str, Query]:
    found = (
        op1_exact_dedup, op2_language_id, op3_chat_formatting, op4_ngram_jaccard_join, op5_source_mixing,
        op6_best_fit_packing, op7_license_scan, op8_sharding, op9_warc, op10_exact_top_k, op11_media_columns,
        op12_phrase_mining, op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


OP1_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))"""


OP4_SQL = r"""
with recursive t as (select translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x, doc_id from documents),
u as (select x, min(doc_id) as low, count(*) as copies, row_number() over (order by x) as u from t group by x),
w as (select u, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as w from u),
s as (select u, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
n as (select u, len(s) as n from s),
i as (select u, unnest(s) as g from s),
met as (select a.u as a, b.u as b, count(*) as c from i a join i b on a.g = b.g and a.u <> b.u group by all),
links as (select a, b from met join n x on x.u = a join n y on y.u = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select u, u as r from u union select reach.u, links.b from reach join links on links.a = reach.r),
component as (select reach.u, min(low) as component_id from reach join u on u.u = reach.r group by reach.u),
linked as (select a as u, sum(copies) as k from links join u on u.u = b group by a)
select doc_id, cast(n as bigint) as n_shingles, case when n > 0 then component_id else doc_id end as component_id,
  cast(case when n > 0 then coalesce(k, 0) + copies - 1 else 0 end as bigint) as n_links
from t join u using (x) join n using (u) join component using (u) left join linked using (u)"""

OP9_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
f as (select page_id, octet_length(b) as n, sha256(b) as d, min(page_id) over (partition by b) as first from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest, case when n >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first then first end as refers_to
from f"""

OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q, v d where q.vec_id % 20 = 0 and q.vec_id <> d.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20"""


def _grams(k: int) -> str:
    return f"select lang, {k} as k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) as phrase from w"


OP12_SQL = rf"""
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
p as (select lang, unnest(string_split_regex(x, '[.,;:!?
-
]')) as p from t),
w as (select lang, regexp_extract_all(p, '[^ 	]+') as w from p),
n as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as ({' union all '.join(_grams(k) for k in range(1, 6))}),
f as (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 100),
s as (select *, string_split(phrase, ' ') as w from f where k > 1),
longer as (select lang, unnest([array_to_string(w[:k - 1], ' '), array_to_string(w[2:], ' ')]) as phrase, f as m from s where k > 2),
c as (select s.* from s left join (select lang, phrase, max(m) as m from longer group by all) x on x.lang = s.lang and x.phrase = s.phrase where x.m is null or 100 * x.m < 100 * s.f),
cut as (select c.lang, c.phrase, c.f as a, j, l.f as l, r.f as r, n.n, cast(1000 as hugeint) * c.f * n.n // (cast(l.f as hugeint) * r.f) as score
  from c join n on n.lang = c.lang, range(1, 5) j(j), f l, f r where j < c.k and l.lang = c.lang and l.phrase = array_to_string(w[:j], ' ') and r.lang = c.lang and r.phrase = array_to_string(w[j + 1:], ' ')),
least as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from least)
select lang, rank, phrase, a, l, r, n, cast(score as bigint) as score from ranked where rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op12_phrase_mining": OP12_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op9_warc": OP9_SQL, "op10_exact_top_k": OP10_SQL, "op1_exact_dedup": OP1_SQL, "op7_license_scan": licenses.oracle_sql()}
