"""The queries of this subpackage, by name, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm import language, quality
from statloom.llm.bytefold import fold_documents
from statloom.llm.common import table
from statloom.llm.conversations import audit_damaged
from statloom.llm.fingerprint import fingerprints
from statloom.llm.jaccard import jaccard_components
from statloom.llm.packing import pack_documents
from statloom.llm.passages import repeated_passages
from statloom.llm.resample import resample
from statloom.llm.search import top_k, whole_vectors
from statloom.llm.sharding import shard_documents
from statloom.llm.tokens import count_edits, encode_documents, sample_edits


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edits(table(spark, sf_dir, "documents").withColumn("edits", sample_edits()))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(whole_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", quality.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_damaged(table(spark, sf_dir, "conversations"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_documents(table(spark, sf_dir, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256"))


QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_bpe": op2_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_passages": op5_passages,
    "op6_quality": op6_quality,
    "op7_top_k": op7_top_k,
    "op8_packing": op8_packing,
    "op9_jaccard": op9_jaccard,
    "op10_language": op10_language,
    "op11_resampling": op11_resampling,
    "op12_conversations": op12_conversations,
    "op13_byte_bpe": op13_byte_bpe,
}
#: Shards as in sharding.py; the CRC-32 comes from its 256-entry table, made by the usual rule, over the bytes of the text.
SHARDING_SQL = """
with crc as (
  select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t
), d as (
  select doc_id, coalesce(cast(doc_id as varchar), 'null') as k, hex(encode(coalesce(text, ''))) as h from documents
), drawn as (
  select doc_id, octet_length(from_hex(h)) + 1 as size, k,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32,
    list_transform(range(17), lambda s: -ln((('0x' || substr(md5(k || ':' || s), 1, 13))::bigint + 1) / 4503599627370496.0::double)) as cost,
    (('0x' || substr(md5(k || ':slot'), 1, 13))::bigint + 1) / 4503599627370496.0::double as draw
  from d, crc
), placed as (
  select *, list_position(cost[1:16], list_min(cost[1:16])) - 1 as shard, list_position(cost, list_min(cost)) - 1 as grown_shard from drawn
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
  row_number() over (partition by shard order by draw, doc_id, text_crc32, size) - 1 as slot, grown_shard::int as grown_shard
from placed
"""
TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, x.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * x.v[i]))::bigint as score
  from v q join v x on q.vec_id % 20 = 0 and x.vec_id <> q.vec_id
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
#: The table of CRC-32 by its usual rule, and the checksum of a hexadecimal text h.
CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"
CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
RESAMPLING_SQL = rf"""
with crc as ({CRC_TABLE}), d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), raw as (select r, unnest(d.w) as w from d
), target as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark
), words as (select w, hex(encode(w)) as h from (select w from raw union select w from target)
), hashed as (select w, {CRC} % 10000 as bucket from words, crc
), s as (select bucket, count(*) as s from raw join hashed using (w) group by bucket
), t as (select bucket, count(*) as t from target join hashed using (w) group by bucket
), gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((select count(*) from raw) + 10000) / ((coalesce(s, 0) + 1)::double * ((select count(*) from target) + 10000))))::bigint as gain from s full join t using (bucket)
), weighed as (
  select d.r, any_value(doc_id) as doc_id, count(raw.r) as n_features, coalesce(sum(gain), 0)::bigint as weight from (select r, doc_id from d) d left join raw using (r) left join hashed using (w) left join gains using (bucket) group by d.r
), scored as (
  select *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score from weighed
), placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id, weight desc, n_features desc) as place from scored
)
select doc_id, n_features::bigint as n_features, weight, score, case when n_features >= 20 and place <= (select count(*) from scored where n_features >= 20) * 10 // 100 then place end::bigint as rank from placed
"""
#: Each step of the recursion reads one turn: for each state the least (cost, letters) of all ways to it, with the repaired turns they give.
CONVERSATIONS_SQL = rf"""
with recursive crc as ({CRC_TABLE}), named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h from conversations
), checked as (select *, {CRC} % 20 as k from named, crc
), damaged as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text from checked, range(case when k = 3 then 2 else 1 end) as copies(c) where k <> 0
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i, rtrim(text, E' \t\n\x0b\x0c\r') as body from damaged
), faulty as (
  select *, case when body = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    left(role, 1) as a, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as two from numbered
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (two not in ('su', 'ua', 'au')) as illegal, count(*) as n from faulty group by conv_id
), convs as (select c.conv_id, coalesce(n, 0) as n, gaps, blank, duplicate, truncated, illegal from (select distinct conv_id from conversations) c left join facts f on c.conv_id is not distinct from f.conv_id
), inserts(q, letter, role, r) as (values (0, 'I', 'user', 2), (1, 'I', 'user', 2), (3, 'I', 'user', 2), (2, 'I', 'assistant', 3)
), ins2 as (select a.q, 'II' as letter, a.role || ':' || chr(10) || b.role || ':' as lines, b.r from inserts a join inserts b on a.r = b.q
), jumps as (
  select q, '' as letter, [] ::varchar[] as lines, q as r, 0 as cost from range(4) as s(q) union all select q, letter, [role || ':'], r, 2 from inserts union all select q, letter, string_split(lines, chr(10)), r, 4 from ins2
), walk as (
  select c.conv_id, 0::bigint as i, j.r::int as q, j.cost::bigint as cost, j.letter as letters, j.lines as lines from convs c, jumps j where j.q = 0
  union all
  select conv_id, i, q, cost, letters, lines from (
    select w.conv_id, w.i + 1 as i, j.r::int as q, w.cost + m.cost + j.cost as cost, w.letters || m.letter || j.letter as letters, w.lines || m.lines || j.lines as lines,
      row_number() over (partition by w.conv_id, j.r order by w.cost + m.cost + j.cost, w.letters || m.letter || j.letter) as best
    from walk w join faulty f on w.conv_id is not distinct from f.conv_id and f.i = w.i + 1,
    lateral (
      select w.q as q, 'D' as letter, []::varchar[] as lines, 3 as cost
      union all select to_q, 'K', [f.role || ':' || f.text], (f.fault = 'truncated')::int from (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) as s(letter, from_q, to_q) where f.fault not in ('blank', 'duplicate') and s.letter = f.a and from_q = w.q
      union all select to_q, 'R', [to_role || ':' || f.text], 2 + (f.fault = 'truncated')::int from (values ('user', 0, 2), ('user', 1, 2), ('user', 3, 2), ('assistant', 2, 3)) as s(to_role, from_q, to_q) where f.fault not in ('blank', 'duplicate') and from_q = w.q
    ) m join jumps j on j.q = m.q
  ) where best = 1
), ended as (
  select w.*, row_number() over (partition by w.conv_id order by w.cost, w.letters) as best from walk w join convs c on w.conv_id is not distinct from c.conv_id where w.i = c.n and w.q in (0, 3)
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  e.cost, e.letters as audit, sha256(array_to_string(e.lines, chr(10))) as repaired_sha256
from convs c join ended e on c.conv_id is not distinct from e.conv_id and e.best = 1
"""
SQL: dict[str, str] = {"op4_sharding": SHARDING_SQL, "op7_top_k": TOP_K_SQL, "op11_resampling": RESAMPLING_SQL, "op12_conversations": CONVERSATIONS_SQL}
