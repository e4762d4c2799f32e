"""One thin query per operator over the tables of a folder, and the SQL that the expressible ones equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, infilling, lattice, mixing, quality, repeats, repetition, sharding, simhash, toxicity, urls, vector_codes
from .common import read

TOKENIZER = "byte_bpe_50k.json"
SHARDS = 16
#: A conversation that holds the template's own marks.
TRICKY = r"\### Assistant: </turn> ok"
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    messages = given.unionByName(added)
    return chat.digests(chat.conversations(messages.withColumn("content", chat.text_part(F.col("text"))))).drop("attachments_sha256")


def chat_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations with an image or a recording before each text and a document after every third."""
    m = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    media = chat.attachment_part(F.when(F.col("turn") % 2 == 0, "image").otherwise("audio"), F.concat("role", F.lit("/"), F.col("turn").cast("string")), F.length("text") % 7)
    page = F.when(F.col("turn") % 3 == 0, chat.attachment_part(F.lit("document"), F.lit("page"), F.lit(None).cast("long")))
    content = F.concat(F.array(media), chat.text_part(F.col("text")), F.array_compact(F.array(page)))
    return chat.digests(chat.conversations(m.withColumn("content", content))).select("conv_id", "n_turns", "n_attachments", "expanded_tokens", "attachments_sha256", "formatted_chars")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_bpe_encoding_and_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path()).drop("text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.judge(docs).drop("text")


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"), SHARDS)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, urls.rules_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilling.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    back = infilling.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


def op13_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_chat_formatting, chat_attachments, op2_simhash_near_dedup, op3_embedding_near_dedup, op4_bpe_encoding_and_decoding, op5_quality_rules, op6_mixing_sources, op7_toxicity, op8_quality_classifier, op9_sharding, op10_url_filters, op11_fill_in_middle, op12_suffix_array_dedup, op13_vector_code_compression)}

_URL = r"""
with cut as (select page_id, case when url is null or instr(url, '://') = 0 then null else substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (select page_id, coalesce(regexp_extract(rest, '^([^/?#]*)', 1), '') as raw, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from parts),
rules(h, f, verdict) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (select page_id, h || f as rule, verdict, row_number() over (partition by page_id, host, path order by length(h || f) desc, h || f) as k
         from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, f))
"""

_ROUND = """a{r} as materialized (select vec_id, part, (least_d % 64) as entry, least_d // 64 as d from (
    select vec_id, part, min(d * 64 + entry) as least_d from (select x.vec_id, x.part, c.entry, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from x join c{b} c using (part)) group by all))"""
_MEANS = """c{r} as materialized (select part, entry, coalesce(m.v, c.v) as v from c{b} c left join (
    select part, entry, list((s - ((s % n) + n) % n) // n order by pos) as v from (select part, entry, pos, sum(v[pos])::bigint as s, count(*) as n from a{b} join x using (vec_id, part), range(1, 5) p(pos) group by all) group by all) m using (part, entry))"""
_CODES = (
    """with k as materialized (select vec_id, label, list_transform(embedding, lambda z: cast(floor(256 * z::double) as bigint)) as w from embeddings where embedding is not null and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0),
x as materialized (select vec_id, part, list_slice(w, 4 * part + 1, 4 * part + 4) as v from k, range(16) p(part)),
c0 as materialized (select part, entry, v from x join (select vec_id, row_number() over (order by vec_id) - 1 as entry from k order by vec_id limit 64) using (vec_id)),
"""
    + ",\n".join([_ROUND.format(r=0, b=0), _MEANS.format(r=1, b=0), _ROUND.format(r=1, b=1), _MEANS.format(r=2, b=1), _ROUND.format(r=2, b=2)])
    + """,
f as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a2 group by 1),
g as (select label, sum(error)::bigint as label_error from f join k using (vec_id) group by 1)
select f.vec_id, code, error, label_error, (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) from c2) as codebooks_sha256
from f join k using (vec_id) join g on k.label is not distinct from g.label"""
)

ORACLES: dict[str, str] = {
    "op10_url_filters": _URL + "select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict from p left join (select * from fits where k = 1) f on p.page_id = f.page_id",
    "op1_chat_formatting": r"""
with m as (select conv_id, turn, role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
esc as (select *, replace(replace(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), '<|', '\<|'), '|>', '\|>') as e from m)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(4 + length(role) + 2 + length(e) + 9) as bigint) as formatted_chars, cast(0 as bigint) as n_attachments, cast(0 as bigint) as expanded_tokens
from esc group by conv_id""",
    "chat_attachments": r"""
with m as (select conv_id, turn, role, coalesce(text, '') as text, length(text) % 7 as units from conversations),
esc as (select *, replace(replace(replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), '<|', '\<|'), '|>', '\|>') as e,
        case when turn % 2 = 0 then 'image' else 'audio' end as kind, case when turn % 3 = 0 then 2 else 1 end as n from m),
placed as (select *, sum(n) over (partition by conv_id order by turn) - n as first from esc),
lines as (select *, cast(first as varchar) || ' ' || kind || ' ' || role || '/' || cast(turn as varchar) || chr(10) || case when n = 2 then cast(first + 1 as varchar) || ' document page' || chr(10) else '' end as refs,
          length('<|' || kind || ':' || cast(first as varchar) || '|>') + case when n = 2 then length('<|document:' || cast(first + 1 as varchar) || '|>') else 0 end as marks from placed)
select conv_id, count(*) as n_turns, cast(sum(n) as bigint) as n_attachments,
       cast(sum(case when kind = 'image' then 256 else 25 end * greatest(1, coalesce(units, 1)) + case when n = 2 then 600 else 0 end) as bigint) as expanded_tokens,
       sha256(string_agg(refs, '' order by turn)) as attachments_sha256, cast(sum(4 + length(role) + 2 + length(e) + marks + 9) as bigint) as formatted_chars
from lines group by conv_id""",
    "op11_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units from documents),
e as (select doc_id, text, units, len(units) as n, ('0x' || substr(h, 1, 8))::bigint % (len(units) + 1) as a, ('0x' || substr(h, 9, 8))::bigint % (len(units) + 1) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
             when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form from d),
c as (select doc_id, text, n, form, array_to_string(list_slice(units, 1, least(a, b)), '') as p, array_to_string(list_slice(units, least(a, b) + 1, greatest(a, b)), '') as m, array_to_string(list_slice(units, greatest(a, b) + 1, n), '') as s from e)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from c""",
    "op13_vector_code_compression": _CODES,
}
