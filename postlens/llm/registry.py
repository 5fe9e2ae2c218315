"""The registered queries of this package and, where DuckDB can say the same, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

import public_tokenizers

from postlens.llm import bpe, langid, mixing, toxicity, warc
from postlens.llm.alignment import aligned
from postlens.llm.common import checkpoint_folder, held_out
from postlens.llm.digests import successor_edits
from postlens.llm.exact import exact_dedup
from postlens.llm.filter_audit import filter_audit, text_filters
from postlens.llm.forest import near_vectors
from postlens.llm.lines import line_dedup
from postlens.llm.simhash import simhash_groups
from postlens.llm.suffix import suffix_dedup


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1(spark: SparkSession, folder: str) -> DataFrame:
    made = line_dedup(_table(spark, folder, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(_table(spark, folder, "embeddings"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.train(docs, _table(spark, folder, "labels"))
    made = toxicity.score(docs.select("doc_id", "text"), model)
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(_table(spark, folder, "documents"))


def op5(spark: SparkSession, folder: str) -> DataFrame:
    made = suffix_dedup(_table(spark, folder, "documents"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    made = bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, folder, "pages"), f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}")
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(_table(spark, folder, "documents"))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows, _ = mixing.mix(_table(spark, folder, "documents"))
    return rows.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    made = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows, failing = text_filters(_table(spark, folder, "documents"))
    labels = _table(spark, folder, "labels").withColumnRenamed("doc_id", "_id")
    losses = {"good_lost": labels.where("quality = 1"), "toxic_lost": labels.where("toxic = 1")}
    return filter_audit(rows, failing, losses)


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return successor_edits(_table(spark, folder, "documents"))


def op13(spark: SparkSession, folder: str) -> DataFrame:
    byte_level, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    made = aligned(_table(spark, folder, "documents"), byte_level, public_tokenizers.PATTERN, pieces, digest=True)
    return made.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_line_dedup": op1,
    "op2_embedding_forest": op2,
    "op3_toxicity": op3,
    "op4_exact_dedup": op4,
    "op5_suffix_array": op5,
    "op6_byte_bpe": op6,
    "op7_warc": op7,
    "op8_simhash": op8,
    "op9_mixing": op9,
    "op10_language_id": op10,
    "op11_filter_audit": op11,
    "op12_fingerprints": op12,
    "op13_token_alignment": op13,
}

OP1_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines
), common as (
  select k, max(doc_id) as last from keyed where length(k) >= 20 group by k having count(distinct doc_id) >= 3
), judged as (
  select keyed.*, common.k is not null and doc_id < last as gone from keyed left join common using (k)
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
"""

OP2_SQL = """
with recursive v as (
  select row_number() over () as r, vec_id, embedding::double[] as e from embeddings
), ok as (
  select * from v where e is not null and len(e) > 0 and not list_contains(list_transform(e, lambda x: x is null or not isfinite(x)), true)
    and list_aggregate(list_transform(e, lambda x: abs(x)), 'max') > 0
), l as (
  select a.r, a.vec_id as u, b.vec_id as w from ok a join ok b on a.r <> b.r and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95
), reach(u, w) as (
  select vec_id, vec_id from v union select reach.u, l.w from reach join l on l.u = reach.w
), c as (
  select u, min(w) as component_id from reach group by u
), n as (
  select r, count(*) as n_links from l group by r
)
select v.vec_id, coalesce(n_links, 0) as n_links, component_id, v.vec_id = component_id as kept
from v left join n using (r) join c on c.u = v.vec_id
"""

OP4_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents
), r as (
  select *, first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size
  from n
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from r
"""

OP5_SQL = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n_bytes from documents
), b as (
  select doc_id, unnest(range(0, greatest(n_bytes - 49, 0), 1000)) as base, n_bytes, h from d
), c as (
  select doc_id, base, least(1000, n_bytes - 49 - base) as m, substr(h, 2 * base + 1, 2098) as part from b
), w as (
  select doc_id, unnest(list_transform(range(m), lambda p: {'p': base + p, 'k': md5_number(substr(part, 2 * p + 1, 100))}), recursive := true) from c
), g as (
  select doc_id, p, min(doc_id) over (partition by k) < doc_id as gone from w
), hit as (
  select doc_id, p, lag(p) over (partition by doc_id order by p) as before from g where gone
), s as (
  select *, sum(case when before is null or p > before + 50 then 1 else 0 end) over (partition by doc_id order by p) as span from hit
), runs as (
  select doc_id, span, min(p) as a, max(p) + 50 as b from s group by doc_id, span
), k as (
  select doc_id, a, b, lag(b) over (partition by doc_id order by a) as was from runs
), parts as (
  select k.doc_id, string_agg(substr(d.h, 2 * coalesce(was, 0) + 1, 2 * (a - coalesce(was, 0))), '' order by a) as front,
         max(b) as last, sum(b - a)::bigint as n_removed, count(*) as n_spans
  from k join d on d.doc_id = k.doc_id group by k.doc_id
)
select d.doc_id, n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join parts on parts.doc_id = d.doc_id
"""

OP7_SQL = """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), d as (
  select *, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::int + 1, 1)), '') as payload_digest,
    min(page_id) over (partition by hex, payload_bytes) as first
  from p
)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from d
"""

OP11_SQL = r"""
with recursive t as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
  from documents
), l as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), f as (
  select t.doc_id, part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(words) < 200 then 'A' else '' end
    || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
    || case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) then 'C' else '' end
    || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
    || case when t.doc_id > min(t.doc_id) over (partition by text) then 'E' else '' end as fails
  from t left join l on l.doc_id = t.doc_id
), kinds as (
  select part, fails, count(*) as n, count(*) filter (where good) as n_good, count(*) filter (where toxic) as n_toxic from f group by part, fails
), p(o) as (
  select '' union all select o || c from p, (values ('A'), ('B'), ('C'), ('D'), ('E')) as v(c) where not contains(o, c)
), steps as (
  select o, s::int as step, substr(o, s, 1) as x, substr(o, 1, s - 1) as head from p, range(1, 6) as r(s) where length(o) = 5
), told as (
  select part, o as filter_order, step, x,
    sum(case when translate(fails, head || x, '') = fails then n else 0 end)::bigint as kept,
    sum(case when contains(fails, x) and translate(fails, head, '') = fails then n else 0 end)::bigint as removed,
    sum(case when contains(fails, x) and translate(fails, head, '') <> fails then n else 0 end)::bigint as redundant,
    sum(case when fails = x then n else 0 end)::bigint as unique_fails,
    sum(case when contains(fails, x) and translate(fails, head, '') = fails then n_good else 0 end)::bigint as good_lost,
    sum(case when contains(fails, x) and translate(fails, head, '') = fails then n_toxic else 0 end)::bigint as toxic_lost
  from kinds, steps group by part, o, step, x
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, x))::bigint as shapley
from told
"""

ORACLES = {"op11_filter_audit": OP11_SQL, "op1_line_dedup": OP1_SQL, "op2_embedding_forest": OP2_SQL, "op5_suffix_array": OP5_SQL, "op7_warc": OP7_SQL, "op4_exact_dedup": OP4_SQL}
