"""The queries of this subpackage, each an operator over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import read
from creditloom.llm.divergence import source_divergence
from creditloom.llm.exact_dedup import exact_duplicates
from creditloom.llm.hard_negatives import hard_negatives
from creditloom.llm.language_model import perplexities
from creditloom.llm.minhash import minhash_duplicates
from creditloom.llm.mixing import mixing_rates
from creditloom.llm.packing import packed_pieces
from creditloom.llm.private_data import private_data
from creditloom.llm.quality_rules import judged
from creditloom.llm.secrets import secrets
from creditloom.llm.simhash import near_duplicates
from creditloom.llm.token_counts import token_counts
from creditloom.llm.url_rules import judged_urls


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(read(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexities(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_url_rules,
        op2_token_counts,
        op3_exact_dedup,
        op4_mixing,
        op5_simhash,
        op6_private_data,
        op7_quality_rules,
        op8_packing,
        op9_language_model,
        op10_secrets,
        op11_hard_negatives,
        op12_source_divergence,
        op13_minhash,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": EXACT_DEDUP,
        "op11_hard_negatives": HARD_NEGATIVES,
        "op12_source_divergence": SOURCE_DIVERGENCE,
    }


EXACT_DEDUP = r"""
with d as (
  select doc_id, length(coalesce(text, '')) points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) h
  from documents
), g as (
  select *, count(*) over (partition by h) group_size,
         first_value(doc_id) over (partition by h order by points desc, doc_id) keep_id
  from d
)
select doc_id, keep_id, group_size, doc_id = keep_id kept, h text_sha256 from g
"""

HARD_NEGATIVES = r"""
with e as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end lab,
         list_transform(embedding, lambda x: floor(256 * x::double)) v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id anchor_id, b.vec_id id, a.lab = b.lab same, list_dot_product(a.v, b.v)::bigint score
  from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
  select * from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.id positive_id,
       row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id)::int "rank",
       s.id negative_id, p.score positive_score, s.score negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same
  and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
qualify row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id) <= 3
"""

SOURCE_DIVERGENCE = r"""
with d as (
  select coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () rid,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
  from documents
), tok as (
  select lang, source, rid, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d
), kept as (
  select lang, term from tok group by 1, 2 having count(distinct rid) >= 3
), n as (
  select lang, source, term, count(*) n from tok join kept using (lang, term) group by 1, 2, 3
), g as (
  select distinct lang, source from d
), gt as (
  select g.lang, g.source, coalesce(sum(n.n), 0)::hugeint total from g left join n using (lang, source) group by 1, 2
), lt as (
  select lang, sum(total)::hugeint total, (select count(*) from kept k where k.lang = gt.lang)::hugeint kept
  from gt group by lang
), every as (
  select g.lang, g.source, k.term, coalesce(n.n, 0) n,
         1 + (1000000000::hugeint * (coalesce(n.n, 0) + 1)) // (gt.total + lt.kept) p
  from g join kept k using (lang) left join n using (lang, source, term)
  join gt using (lang, source) join lt using (lang)
), whole as (
  select n.lang, n.term, 1 + (1000000000::hugeint * (sum(n.n) + 1)) // (any_value(lt.total) + any_value(lt.kept)) q
  from n join lt using (lang) group by 1, 2
), pair as (
  select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) v
  from every a join every b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), pairs as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(pair.v, 0)::bigint "value"
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
), terms as (
  select e.lang, e.source, 'term' part, e.term item, ((e.p - w.q) * (e.p - w.q) // w.q)::bigint "value"
  from every e join whole w using (lang, term) where e.n > 0 and e.p > w.q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by "value" desc, item)::int "rank"
  from (select * from pairs union all select * from terms)
)
select * from ranked where part = 'pair' or "rank" <= 200
"""
