"""The operators' queries over the given tables, and SQL for those that it can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmentry.llm.alignment import tokenizer_alignment
from segmentry.llm.ann import nearest
from segmentry.llm.html_extract import main_text
from segmentry.llm.language_id import languages
from segmentry.llm.mixing import mixed
from segmentry.llm.near_dup import near_duplicates
from segmentry.llm.packing import pack_documents
from segmentry.llm.prefix_trie import prefix_trie
from segmentry.llm.quality import quality_scores
from segmentry.llm.substring_dedup import remove_repeats
from segmentry.llm.topk import exact_top_k
from segmentry.llm.toxicity import toxicity_scores
from segmentry.llm.url_filter import url_verdicts

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages")).drop("score")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), RANKS)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment(_table(spark, sf_dir, "documents"), RANKS, PIECES)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_quality, op3_url_filter, op4_mix_sources, op5_pack, op6_exact_top_k, op7_nearest, op8_main_text, op9_substring_dedup, op10_toxicity,
        op11_align_tokenizers, op12_prefix_trie, op13_languages,
    )
}

_MIX = r"""
with base as (
  select doc_id, coalesce(source, '') as source,
    coalesce(len(regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+')), 0) as n_tokens from documents),
sizes as (select source, cast(sum(n_tokens) as bigint) as t from base group by 1),
shares as (select source, t, t / cast((select sum(t) from sizes) as double) as p from sizes),
ends as (select min(p) as lo, max(p) as hi from shares where p > 0),
power as (select case when hi / lo <= 2 * (1 + 1e-12) then 0.0
  else ceil(round(1e6 * (1 - ln(2.0) / ln(hi / lo)), 3)) / 1e6 end as x from ends),
weighed as (select source, t, case when t > 0 then pow(p, (select x from power)) else 0.0 end as u from shares),
quotas as (select source, t, case when t > 0 then round((select max(t / u) from weighed where t > 0) * u / t, 9) else 1.0 end as times from weighed),
q as (select source, t, cast(floor(times) as bigint) as n_full, cast(floor(times * t + 0.5) as bigint) as quota from quotas),
uses as (select b.*, q.t, q.n_full, q.quota, e.epoch, md5(concat_ws(':', coalesce(cast(doc_id as varchar), ''), cast(e.epoch as varchar), '1')) as k
  from base b join q using (source) join (select unnest(range(0, 1000)) as epoch) e on e.epoch <= q.n_full),
run as (select *, epoch * t + coalesce(sum(n_tokens) over (partition by source, epoch order by k, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as start from uses),
n as (select greatest(1, cast(ceil(sum(quota) / 100000.0) as bigint)) as blocks from q),
taken as (select run.*, cast(case when t = 0 then cast(('0x' || substr(k, 1, 3)) as bigint) * n.blocks // 4096 else least((start * n.blocks) // greatest(quota, 1), n.blocks - 1) end as bigint) as block from run cross join n
  where epoch < n_full or start < quota)
select doc_id, source, cast(n_tokens as bigint) as n_tokens, epoch, block,
  cast(row_number() over (partition by block order by reverse(k), doc_id, n_tokens) as int) as position from taken
"""

_TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id,
    cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(rank as int) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""

# crc32 bit by bit, and each family's difference; a node is a list of turns.
_TRIE = """
with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
numbered as (select *, row_number() over (partition by c order by turn nulls first, role, sha256(concat(strlen(role), ':', role, text))) as k from t),
crc as (select c, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::ubigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: i::ubigint)), lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384::ubigint) else r >> 1 end)),
    4294967295::ubigint) % 9 as h from (select distinct c from t)),
turns as (select crc.c, 0 as part, k, role, text from crc join numbered n on n.c = crc.c - ((crc.c % 5) + 5) % 5 and k <= h
  union all select crc.c, 1, k, role, text from crc join numbered n on n.c = crc.c and k > h),
seqs as (select crc.c, coalesce(list({'role': role, 'text': text} order by part, k) filter (k is not null), []) as s from crc left join turns using (c) group by crc.c),
steps as (select c, s, d, s[1:d] as p from (select c, s, unnest(range(0, len(s) + 1)) as d from seqs)),
nodes as (select d, p, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(c::varchar, ',' order by c) filter (len(s) = d), '') as ends,
    (count(*) - 1) * coalesce(strlen(p[d].text), 0) as saved from steps group by d, p),
kids as (select d - 1 as d, p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by all),
up as (select n.*, unnest(range(0, d + 1)) as e, coalesce(kids.n, 0) as n_children from nodes n left join kids using (d, p)),
below as (select e as d, p[1:e] as p, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved from up group by all)
select n.conv_id, n.d as depth, parent.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n, 0) as n_children, b.n_leaves, cast(b.saved as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join below b using (d, p) left join kids using (d, p) left join nodes parent on parent.d = n.d - 1 and parent.p = n.p[1:n.d - 1]
"""

ORACLES = {"op12_prefix_trie": _TRIE, "op4_mix_sources": _MIX, "op6_exact_top_k": _TOP_K}
