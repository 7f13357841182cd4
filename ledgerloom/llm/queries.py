"""The llm operators as queries on the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licences, mixing, preferences, quality, sharding, simhash, subspace, token_spans, toxicity
from .common import table


def op1_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.grouped(table(spark, sf_dir, "embeddings"))


def op2_mix_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op4_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def op5_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line's end belongs to the line it starts in."""
    return token_spans.counted(table(spark, sf_dir, "documents"), rule="start")


def op6_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected one of pair k."""
    turns = table(spark, sf_dir, "conversations")
    rows = preferences.paired(turns, F.shiftright("conv_id", 1), F.pmod("conv_id", F.lit(2)) == 0)
    spans = lambda c: F.expr(f"array_join(transform({c}, x -> concat(x.start, '-', x.end)), ' ')").alias(c)
    return rows.select("pair_id", "chunk", "prompt", "chosen", spans("chosen_mask"), "rejected", spans("rejected_mask"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(licences.scanned(table(spark, sf_dir, "documents")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("d", "difference")


def queries() -> dict:
    return {f.__name__: f for f in (op1_subspace_join, op2_mix_weights, op3_toxicity, op4_flow_sharding, op5_token_spans, op6_preference_pairs, op7_licence_scan, op8_decontaminate, op9_simhash, op10_compression_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op1_subspace_join": OP1_SQL, "op6_preference_pairs": OP6_SQL, "op8_decontaminate": OP8_SQL}


#: All pairs at double precision, and the components by spreading the smallest id.
OP1_SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a
), least as (select a as vec_id, min(b) as component_id from reach group by 1)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links, component_id, e.vec_id = component_id as kept from embeddings e join least using (vec_id)
"""

#: Windows of documents of every length that windows of items have, met by equality.
OP8_SQL = """
with iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark where text is not null
), win as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') as s from iw, unnest(range(1, greatest(2, len(w) - 8))) t(k) where len(w) > 0
), d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents
), dw as (
  select doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') as s from d, (select distinct n from win) x, unnest(range(1, greatest(1, len(w) - n + 2))) t(k)
), hit as (select distinct doc_id, dw.n, k, item_id from dw join win using (n, s)),
words as (select doc_id, count(distinct p) as n_hit from hit, unnest(range(k, k + n)) t(p) group by 1),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hit group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""


OP6_SQL = """
with t as (
  select conv_id // 2 as pair_id, conv_id % 2 as side, turn, role, text,
    row_number() over (partition by conv_id order by turn) - 1 as position
  from (select distinct conv_id, turn, role, text from conversations)
), d as (
  select coalesce(a.pair_id, b.pair_id) as pair_id, min(coalesce(a.position, b.position)) as shared
  from (select * from t where side = 0) a full join (select * from t where side = 1) b
    on a.pair_id = b.pair_id and a.position = b.position
  where a.pair_id is null or b.pair_id is null or a.role is distinct from b.role or a.text is distinct from b.text
  group by 1
), p as (
  select t.*, (shared is null or position < shared) as is_prompt from t left join d using (pair_id)
), s as (
  select pair_id, position // 256 as chunk, position, case when is_prompt then 'prompt' when side = 0 then 'chosen' else 'rejected' end as part,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) as segment,
    (not is_prompt and role is not distinct from 'assistant') as loss
  from p where not (is_prompt and side = 1)
), m as (
  select *, sum(length(segment)) over (partition by pair_id, chunk, part order by position) as stop from s
)
select pair_id, chunk, coalesce(string_agg(segment, '' order by position) filter (part = 'prompt'), '') as prompt,
  coalesce(string_agg(segment, '' order by position) filter (part = 'chosen'), '') as chosen,
  coalesce(string_agg(cast(stop - length(segment) as varchar) || '-' || cast(stop as varchar), ' ' order by position) filter (part = 'chosen' and loss), '') as chosen_mask,
  coalesce(string_agg(segment, '' order by position) filter (part = 'rejected'), '') as rejected,
  coalesce(string_agg(cast(stop - length(segment) as varchar) || '-' || cast(stop as varchar), ' ' order by position) filter (part = 'rejected' and loss), '') as rejected_mask
from m group by 1, 2
"""
