"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from . import bpe, chat, collocations, coversearch, fingerprints, jaccard, langid, merkle, mixing, quality, secrets, streamdedup, urlrank
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_chat(spark, sf_dir):
    return chat.for_comparison(chat.perspectives(table(spark, sf_dir, "conversations")))


def op2_quality(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_urls(spark, sf_dir):
    return urlrank.judge(table(spark, sf_dir, "pages"))


def op4_bpe(spark, sf_dir):
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER, keep=["doc_id"]))


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    return langid.identify(docs, langid.trained(docs), ["doc_id", "held_out"])


def op7_cover(spark, sf_dir):
    return coversearch.top_products(table(spark, sf_dir, "embeddings"))


def op8_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_dedup(spark, sf_dir):
    out = streamdedup.deduplicate(table(spark, sf_dir, "documents"), as_files=True)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", F.col("digest").alias("text_sha256"))


def op10_secrets(spark, sf_dir):
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op11_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_merkle(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.drop_newlines(F.col("doc_id"), F.col("text")))


def op13_fingerprints(spark, sf_dir):
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat": op1_chat,
    "op2_quality": op2_quality,
    "op3_urls": op3_urls,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_langid": op6_langid,
    "op7_cover": op7_cover,
    "op8_jaccard": op8_jaccard,
    "op9_dedup": op9_dedup,
    "op10_secrets": op10_secrets,
    "op11_collocations": op11_collocations,
    "op12_merkle": op12_merkle,
    "op13_fingerprints": op13_fingerprints,
}

SQL = {
    "op7_cover": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
  from v q join v d on q.vec_id % 100 = 0 and q.vec_id <> d.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op1_chat": chat.SQL,
    "op11_collocations": collocations.SQL,
    "op12_merkle": merkle.SQL,
    "op9_dedup": r"""
with t as (select doc_id, coalesce(length(text), 0) as points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents),
w as (select *, first_value(doc_id) over g as keep_id, count(*) over (partition by text_sha256) as group_size,
    row_number() over g = 1 as kept
  from t window g as (partition by text_sha256 order by points desc, doc_id))
select doc_id, keep_id, group_size, kept, text_sha256 from w""",
    "op5_mixing": r"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         substr(md5('17:' || doc_id::varchar), 1, 16) as u from documents),
src as (select source, sum(size)::bigint as source_size from sizes group by source),
ranked as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from src),
ratio as (select *, 3.0::double * source_size / weight as r from ranked),
cuts as (select a.source, a.source_size, a.weight, a.r,
   (select coalesce(sum(3 * b.source_size), 0)::bigint from ratio b where b.r < a.r) as held,
   (select coalesce(sum(b.weight), 0)::bigint from ratio b where b.r < a.r) as held_w from ratio a),
tot as (select sum(source_size)::bigint as t, sum(weight)::bigint as w from src join ranked using (source, source_size)),
lvl as (select (t - held)::double / (w - held_w)::double as level from cuts, tot where (t - held)::double / (w - held_w)::double <= r order by r limit 1),
tgt as (select source, source_size, least(weight * level, (3 * source_size)::double) as target from ranked, lvl),
queue as (select s.*, g.source_size, g.target, row_number() over (order by s.source nulls last, u, doc_id, size) as row,
   sum(size) over (partition by s.source order by u, doc_id, size rows unbounded preceding)::bigint as seen
   from sizes s join tgt g on s.source is not distinct from g.source),
items as (select *, case when target > 0 then (seen + epoch * source_size)::double / target else 0.0::double end as finish
   from queue, (values (0), (1), (2)) e(epoch)),
spent as (select *, sum(size) over (order by finish, u, row, epoch rows unbounded preceding)::bigint as spent from items)
select doc_id, source, size, source_size, target,
  sum(greatest(0, least(size, t - spent + size)))::bigint as taken
from spent, tot group by row, doc_id, source, size, source_size, target""",
}
