"""Queries that apply the operators to whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagwright.llm.pii import iban_pattern


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagwright.llm.exact_topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagwright.llm.substring import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagwright.llm.near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from dagwright.llm.bpe import bpe_decode, bpe_encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN).withColumn("decoded", bpe_decode(F.col("ids"), path))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagwright.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagwright.llm.toxicity import fit, held_out, toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagwright.llm.chat import chat_format, conversations_of, masked_text, read_back

    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    out = chat_format(conversations_of(rows), "record", roles={}).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_mask")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagwright.llm.pii import BASE, find_pii

    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, BASE), F.sha2(joined(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from dagwright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dagwright.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_byte_bpe, op3_nearest, op4_toxicity, op5_chat_format, op6_pii, op7_packing, op8_exact_topk, op9_substring_dedup, op10_jump_sharding)}

#: DuckDB: kind, pattern, and the test of a match m whose digits are d.
PII_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or coalesce(try_cast(nullif(ltrim(p, '0'), '') as int), 0) > 255)) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(d) between 12 and 19 and list_sum(list_transform(range(length(d)), lambda i: case when i % 2 = 0 then cast(d[length(d) - i] as int) else (cast(d[length(d) - i] as int) * 2) % 10 + (cast(d[length(d) - i] as int) * 2) // 10 end)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) between 9 and 15"),
    ("iban", r"\b" + iban_pattern() + r"\b", "list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4), ''), lambda c: case when ascii(c) >= 65 then ascii(c) - 55 else ascii(c) - 48 end)), lambda r, c: case when c > 9 then (r * 100 + c) % 97 else (r * 10 + c) % 97 end) = 1"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", r"regexp_matches(substr(t, greatest(start - 40, 0) + 1, least(start, 40)), '(?i)\b(?:ssn|social|security)\b')"),
)


def pii_sql() -> str:
    each = " union all ".join(f"""
select * from (select *, {rank} as rank, '{kind}' as kind from (select rid, t, m, regexp_replace(m, '[^0-9]', '', 'g') as d, b + list_sum(list_transform(list_slice(parts, 1, i), lambda p: length(p)))::bigint as start from (
  select rid, t, parts, i, found[i] as m, coalesce(list_sum(list_transform(list_slice(found, 1, i - 1), lambda x: length(x))), 0)::bigint as b from (
    select rid, t, parts, found, unnest(range(1, len(found) + 1)) as i from (select rid, t, regexp_extract_all(t, '{pattern}') as found, string_split_regex(t, '{pattern}') as parts from d))))) where {test}""" for rank, (kind, pattern, test) in enumerate(PII_SQL))
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), s as ({each}),
j as (select rid, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
  string_agg(kind || ':' || start || ':' || (start + length(m)), ',' order by start, rank) filter (rank < 4) as base, string_agg(kind || ':' || start || ':' || (start + length(m)), ',' order by start, rank) as spans from s group by rid)
select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join j using (rid)"""


#: DuckDB: jump hashes of every id by the published loop, in 128-bit whole numbers; checksums byte by byte, by a table worked out here.
SHARD_SQL = """
with recursive tab as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, e: xor(a >> 1, 3988292384 * (a & 1))) order by i) as t from range(256) r(i)
), d as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size, hex(encode(coalesce(text, ''))) as h from documents
), c as (
  select doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::bigint)),
    lambda a, e: xor(a >> 8, t[(xor(a, e) & 255) + 1])), 4294967295) as text_crc32 from d, tab
), k as (
  select distinct coalesce(doc_id, 0) as id, n, (case when coalesce(doc_id, 0) < 0 then coalesce(doc_id, 0)::hugeint + 18446744073709551616 else coalesce(doc_id, 0) end)::hugeint as key, -1::bigint as b, 0::bigint as j from documents, (values (16), (17)) v(n)
), s as (
  select * from k
  union all
  select id, n, key2, j, floor((j + 1) * (2147483648.0::double / ((key2 // 8589934592) + 1)::double))::bigint from (select *, (key * 2862933555777941757 + 1) % 18446744073709551616 as key2 from s where j < n)
), f as (
  select id, max(b) filter (n = 16) as shard, max(b) filter (n = 17) as grown_shard from s group by id
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard, row_number() over (partition by shard order by doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard::int as grown_shard
from c join f on f.id = coalesce(doc_id, 0)
"""

SQL = {
    "op10_jump_sharding": SHARD_SQL,
    "op8_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
""",
    "op6_pii": pii_sql(),
    "op5_chat_format": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)
), e as (
  select *, regexp_replace(replace(text, '\\', '\\\\'), '(<\||</?s>|\[/?INST\]|<<?/?SYS>>)', '\1\\', 'g') as esc from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum(length(esc) + length(role) + 24)::bigint as formatted_chars
from e group by conv_id
""",
    "op9_substring_dedup": r"""
with w as (
  select row_number() over () as rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents
), p as (
  select rid, unnest(range(1, len(words) - 33)) as i, words from w where len(words) >= 35
), h as (
  select rid, i, array_to_string(words[i:i + 34], ' ') as s from p
), r as (
  select rid, i from (select rid, i, count(*) over (partition by s) as n from h) where n > 1
), g as (
  select rid, list(distinct j) as gone from (select rid, unnest(range(i, i + 35)) as j from r) group by rid
), f as (
  select w.rid, doc_id, words, coalesce(gone, []) as gone from w left join g using (rid)
), k as (
  select rid, string_agg(words[j], ' ' order by j) as kept from (select f.rid, f.words, unnest(range(1, len(f.words) + 1)) as j from f) x
  where not exists (select 1 from (select rid, unnest(gone) as j from f) y where y.rid = x.rid and y.j = x.j) group by rid
)
select f.doc_id, cast(len(words) as bigint) as n_words, cast(len(gone) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from f left join k using (rid)
""",
}
