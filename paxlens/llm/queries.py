"""The ten queries of this subpackage with production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, embedding_dedup, kd_shards, mixing, packing, quality, simhash, token_files, toxicity, warc
from .common import WORD, read
from .tokens import public_path


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), 0.93)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"), bits=4, words=4)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_tokens(read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), 2)
    return token_files.read_tokens(spark, manifest)


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.sharded(read(spark, sf_dir, "documents"), 40)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), 2)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(spark, warc.write_warc(read(spark, sf_dir, "pages")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents")).drop("source")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_embedding_dedup, op2_simhash, op3_token_files, op4_kd_shards, op5_packing, op6_toxicity, op7_warc, op8_mixing, op9_quality, op10_ann)
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": """
with recursive e as (
  select vec_id, label, embedding::double[] as v from embeddings
), good as (
  select * from e where label is not null and v is not null
    and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) as (
  select vec_id, vec_id from e
  union
  select r.a, l.b from reach r join link l on r.b = l.a
)
select e.vec_id, coalesce((select count(*) from link l where l.a = e.vec_id), 0)::bigint as n_links,
  (select min(b) from reach r where r.a = e.vec_id) as component_id,
  e.vec_id = (select min(b) from reach r where r.a = e.vec_id) as kept
from e""",
    "op7_warc": """
with p as (
  select page_id, coalesce(html, '') as payload from pages
), d as (
  select page_id, octet_length(encode(payload))::bigint as payload_bytes, sha1(payload) as h, max(page_id) over (partition by payload) as last from p
)
select page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::bigint, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), 'string_agg', '') as payload_digest,
  case when page_id is not distinct from last then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from last then last end as refers_to
from d""",
    "op8_mixing": f"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    md5('mix|' || coalesce(doc_id::varchar, 'null|' || md5(coalesce(text, '')))) as key
  from documents
), s as (
  select source, sum(size)::bigint as n, ([3, 1, 2])[1 + (row_number() over (order by encode(source) nulls last) - 1) % 3]::double as w from d group by source
), r as (
  select *, 2.0 * n as cap, sum(n) over () * 1.5::double as whole,
    sum(2.0 * n) over (order by 2.0 * n / w, encode(source) nulls last) - 2.0 * n as caps, sum(w) over (order by 2.0 * n / w desc, encode(source) desc nulls first) as ws
  from s
), k as (
  select coalesce(min(2.0 * n / w) filter (where (whole - caps) * w / ws <= cap), 1e300) as edge from r
), f as (
  select whole - coalesce(sum(cap) filter (where cap / w < edge), 0) as rest, sum(w) filter (where cap / w >= edge) as ws from r, k group by whole
), t as (
  select source, n, case when cap / w < edge then cap::double else rest::double * w / f.ws::double end as target from r, k, f
), o as (
  select d.*, t.n as source_size, t.target,
    coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (case when source_size > 0 then (round(target)::bigint // source_size) * size
    + greatest(0, least(size, round(target)::bigint - (round(target)::bigint // source_size) * source_size - before)) else 0 end)::bigint as taken
from o""",
}
