"""Registered queries of the numbered operators, each over its whole table, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterflow.llm import (chat, decontamination, line_dedup, mixing, ngram_join, packing, pii, prefix_trie, quality, search,
                            structure_repair, token_counts, warc)
from rosterflow.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(pages)
    records = warc.read_archives(warc.write_archives(pages, folder), folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), count_links=True)


def edits_of(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, edits): an insertion, a replacement and a deletion that follow from each text."""
    at = F.pmod(F.xxhash64("text"), F.greatest(F.length("text"), F.lit(1))).cast("int")
    kind = "array<struct<start:int,end:int,text:string>>"
    edits = F.array(
        F.struct(at.alias("start"), at.alias("end"), F.lit(" and another 12 words").alias("text")),
        F.struct((at / 2).cast("int").alias("start"), ((at / 2).cast("int") + 9).alias("end"), F.expr("left(text, 24)").alias("text")),
        F.struct((at / 3).cast("int").alias("start"), ((at / 3).cast("int") + 40).alias("end"), F.lit("").alias("text")))
    return docs.select("doc_id", "text", edits.cast(kind).alias("edits"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = edits_of(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.apply_edits(token_counts.count_tokens(docs, tokenizer), tokenizer).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.read_back(chat.render(chat.messages(chat.events_of(rows))))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_like(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.regrafted(prefix_trie.turns_of(table(spark, sf_dir, "conversations"))))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair_damage(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_warc, op2_packing, op3_decontamination, op4_ngram_join, op5_token_counts, op6_quality, op7_pii, op8_chat,
    op9_line_dedup, op10_search, op11_mixing, op12_prefix_trie, op13_structure_repair)}

ORACLES = {
    "op1_warc": r"""
with sums as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex from pages),
bits as (
  select page_id, body, array_to_string(list_transform(string_split(hex, ''),
    lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') as b from sums),
firsts as (select *, min(page_id) over (partition by body) as first from bits)
select page_id, octet_length(encode(body))::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * b[5 * i + 1]::int + 8 * b[5 * i + 2]::int + 4 * b[5 * i + 3]::int + 2 * b[5 * i + 4]::int + b[5 * i + 5]::int, 1)), '')
    as payload_digest,
  case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from firsts""",
    "op8_chat": r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'))
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 14 as n from given)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(n)::bigint as formatted_chars
from sized group by conv_id""",
    "op3_decontamination": r"""
with texts as (
  select doc_id as id, text, true as doc from documents union all select item_id, text, false from benchmark),
split as (
  select id, doc, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from texts),
items as (
  select distinct id as item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
    lambda i: array_to_string(w[i:i + 9], ' '))) as g from split where not doc and len(w) > 0),
sized as (select *, len(string_split(g, ' ')) as m from items),
grams as (
  select id as doc_id, k.m, unnest(range(1, len(w) - k.m + 2)) as pos, unnest(list_transform(range(1, len(w) - k.m + 2),
    lambda i: array_to_string(w[i:i + k.m - 1], ' '))) as g
  from split, (select distinct m from sized) k where doc and len(w) >= k.m),
hits as (select doc_id, pos, m, item_id from grams join sized using (g, m)),
covered as (select distinct doc_id, unnest(range(pos, pos + m)) as word from hits),
counted as (select doc_id, count(*) as n_hit from covered group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
  from (select distinct doc_id, item_id from hits) group by doc_id)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from split left join counted on counted.doc_id = id left join named on named.doc_id = id where doc""",
    "op4_ngram_join": r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
grams as (select doc_id, unnest(s) as g from sets),
overlap as (
  select a.doc_id as x, b.doc_id as y, count(*) as common from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id
  group by all),
links as (
  select x, y from overlap join sets a on a.doc_id = x join sets b on b.doc_id = y
  where 100 * common >= 80 * (len(a.s) + len(b.s) - common)),
ends as (select x, y from links union all select y, x from links),
reach(doc_id, other) as (
  select doc_id, doc_id from sets union select r.doc_id, e.y from reach r join ends e on e.x = r.other)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.other) as component_id,
  (select count(*) from ends e where e.x = s.doc_id) as n_links
from sets s join reach r using (doc_id) group by s.doc_id, len(s.s)""",
    "op9_line_dedup": r"""
with lines as (
  select doc_id, unnest(l) as line, generate_subscripts(l, 1) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
firsts as (select k, min(doc_id) as first from keyed where length(k) >= 10 group by k having count(distinct doc_id) > 1),
marked as (select keyed.*, coalesce(doc_id > first, false) as gone from keyed left join firsts using (k))
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id""",
    "op12_prefix_trie": r"""
with given as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role,
    sha256(length(role) || chr(10) || role || chr(10) || text)) as pos,
    sha256(length(role) || chr(10) || role || chr(10) || text) as id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
convs as (
  select conv_id, conv_id - conv_id % 20 as base, (4294967295 - list_reduce(list_prepend(4294967295::bigint,
    list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda crc, byte:
    list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 4 as h
  from (select distinct conv_id from given)),
sized as (
  select c.*, least(h, (select count(*) from given g where g.conv_id = c.base)) as k from convs c),
turns as (
  select s.conv_id, pos, id, words from sized s join given g on g.conv_id = s.base where pos <= h
  union all select s.conv_id, pos - h + k, id, words from sized s join given g using (conv_id) where pos > h),
paths as (select conv_id, list(id order by pos) as p, list(words order by pos) as w from turns group by conv_id),
held as (select conv_id, coalesce(p, []) as p, coalesce(w, []) as w from convs left join paths using (conv_id)),
prefixes as (
  select conv_id, d, array_to_string(p[1:d], ',') as node, array_to_string(p[1:d - 1], ',') as up,
    case when d > 0 then w[d] else 0 end as words, len(p) = d as ends
  from (select *, unnest(range(len(p) + 1)) as d from held)),
nodes as (
  select node, d, min(up) as up, min(conv_id) as conv_id, count(*) as n, min(words) as words,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as sha
  from prefixes group by node, d),
children as (select up as node, count(*) as n_children from nodes where d > 0 group by up),
sums as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (node)),
under as (select distinct a.node as top, b.node from prefixes a join prefixes b on a.conv_id = b.conv_id and a.d <= b.d),
totals as (
  select top, count(*) filter (where n_children = 0) as n_leaves, sum((n - 1) * words)::bigint as saved_tokens
  from under join sums using (node) group by top)
select s.conv_id, s.d::bigint as depth, case when s.d > 0 then u.conv_id end as parent_conv_id, s.n as n_convs, s.n_children,
  n_leaves, saved_tokens, s.sha as ends_sha256
from sums s join totals on top = s.node left join nodes u on u.node = s.up""",
}
