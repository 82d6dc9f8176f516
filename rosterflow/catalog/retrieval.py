"""Knowledge and retrieval queries."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.catalog import views as V
from rosterflow.catalog.privacy import SNIPPET_SQL, TOKENS_SQL
from rosterflow.functions import text as text_fn
from rosterflow.operators import dialogue, retrieval
from rosterflow.session import shared_dir
from rosterflow.sources import knowledge


_INDEX_TABLES: dict[tuple[str, str], tuple[int, str]] = {}


def sections(spark, sf):
    return V.view(spark, sf, V.CHUNKS)


def chunks(spark, sf, parts=None):
    return knowledge.ingest(sections(spark, sf), "n", parts=parts)


def indexed(spark, sf):
    """The chunk index, built and stored once per session and data folder, and anew when the documents have changed."""
    key = (spark.sparkContext.applicationId, sf)
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    status = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(source)
    stamp = status.getModificationTime()
    known, name = _INDEX_TABLES.get(key, (None, None))
    if known != stamp:
        if name:
            for part in ("", "_terms", "_totals"):
                spark.sql(f"drop table if exists {name}{part}")
        name = f"chunk_index_{uuid.uuid4().hex}"
        total_chars = sections(spark, sf).agg(F.sum(F.length("content"))).first()[0]
        parts = knowledge.part_count(total_chars or 0, spark.sparkContext.defaultParallelism)
        path = shared_dir(spark, "chunk-index")
        knowledge.store_statistics(knowledge.store_index(chunks(spark, sf, parts), name, path), name, path)
        _INDEX_TABLES[key] = stamp, name
    return spark.table(name)


def lookup(spark, sf):
    """Retriever and FAQ fallback over the stored index and its statistics."""
    rows = indexed(spark, sf)
    _, name = _INDEX_TABLES[spark.sparkContext.applicationId, sf]
    stats = retrieval.Statistics(spark.table(f"{name}_terms"), spark.table(f"{name}_totals"))
    return rows, {"retriever": partial(retrieval.retrieve, stats=stats), "fallback": partial(retrieval.faq_fallback, stats=stats)}


def questions(spark, sf):
    return V.view(spark, sf, V.QUESTIONS)


def turns(spark, sf):
    return V.view(spark, sf, V.TURNS).select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def kb_ingest(spark, sf):
    return knowledge.ingest(sections(spark, sf), "n").select(
        "chunk_id", "doc_id", "category", "title", "section", F.length("content").alias("n_chars"))


def chunk_documents(spark, sf):
    rows = sections(spark, sf)
    meta = knowledge.document_metadata(rows, "n").select(
        "doc_id", F.col("title").alias("doc_title"), F.col("category").alias("doc_category"))
    return chunks(spark, sf).join(meta, "doc_id").select("chunk_id", "doc_id", "doc_title", "doc_category")


def kb_replace_category(spark, sf):
    path = shared_dir(spark, "chunks")
    loaded = chunks(spark, sf).select("chunk_id", "doc_id", "category", "section", "n_chars")
    knowledge.write_chunks(loaded, path)
    fresh = loaded.withColumn("chunk_id", F.concat("chunk_id", F.lit("-v2"))).filter("section <> ''")
    knowledge.replace_category(fresh, "FAQ", path)
    return spark.read.schema(loaded.schema).parquet(path).select("chunk_id", "category", "section")


def kb_counts(spark, sf):
    per_category = sections(spark, sf).groupBy(F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    total = per_category.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("name"), "n")
    active = turns(spark, sf).groupBy("session_id").count().agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("active_sessions").alias("name"), "n")
    return per_category.unionByName(total).unionByName(active)


def kb_union(spark, sf):
    """The chunks of all categories, those without a known one included: one scan, as the category is a column."""
    return chunks(spark, sf).select("chunk_id", "category")


def material_list(spark, sf):
    return retrieval.material_list(chunks(spark, sf), "GRADUATE").select("chunk_id", "doc_id", "section", "snippet", "score")


def term_stats(spark, sf):
    rows, found = lookup(spark, sf)
    total = found["retriever"].keywords["stats"].totals.agg(F.sum("n_chunks").alias("n")).select("n").scalar()
    return retrieval.term_stats(rows).withColumn("idf", F.round(retrieval.idf(F.col("df"), total), 6))


def bigram_overlap(spark, sf):
    """Overlap of each turn with the one after it."""
    spoken = turns(spark, sf).withColumn("g", text_fn.bigrams(F.col("content")))
    after = spoken.select("session_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("next_g"))
    pairs = spoken.join(after, ["session_id", "turn"])
    return pairs.select("session_id", "turn", F.size("g").alias("n_grams"),
                        F.round(text_fn.overlap(F.col("g"), F.col("next_g")), 6).alias("overlap"))


def bm25_scores(spark, sf):
    rows, found = lookup(spark, sf)
    return retrieval.bm25_scores(questions(spark, sf), rows, found["retriever"].keywords["stats"]).select(
        "question_id", "chunk_no", F.round("bm25", 6).alias("bm25"), "zero_chunks")


def _found(spark, sf, k=C.TOP_K, category=None):
    rows, found = lookup(spark, sf)
    return found["retriever"](questions(spark, sf).select("question_id", "question"), rows, k, category)


def hybrid_topk(spark, sf):
    return _found(spark, sf).select(
        "question_id", "rank", "chunk_id", "category", "section", F.round("score", 6).alias("score"))


def hybrid_topk_poi(spark, sf):
    return _found(spark, sf, 3, "POI").select("question_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def retrieval_confidence(spark, sf):
    asked = questions(spark, sf).select("question_id", "question")
    return retrieval.confidence(asked, _found(spark, sf, 1)).select(
        "question_id", F.round("top_score", 6).alias("top_score"), "low_confidence")


def faq_fallback(spark, sf):
    asked = questions(spark, sf).select("question_id", "question")
    rows, found = lookup(spark, sf)
    return found["fallback"](asked, rows).select(
        "question_id", "hit", "reply", F.round("score", 6).alias("score"))


def conversation_context(spark, sf):
    recent = dialogue.recent_history(turns(spark, sf), rounds=2)
    shown = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return recent.select("session_id", F.size("history").alias("messages"), F.array_join(shown, "\n").alias("history"))


def token_usage(spark, sf):
    return dialogue.token_usage(turns(spark, sf))


def frequent_questions(spark, sf):
    typed = V.view(spark, sf, V.MESSAGES).select("message")
    spoken = turns(spark, sf).filter("role = 'user'").select(F.col("content").alias("message"))
    return dialogue.frequent_questions(typed.unionByName(spoken), 20)


QUERIES = {fn.__name__: fn for fn in (
    kb_ingest, chunk_documents, kb_replace_category, kb_counts, kb_union, material_list, term_stats, bigram_overlap,
    bm25_scores, hybrid_topk, hybrid_topk_poi, retrieval_confidence, faq_fallback, conversation_context, token_usage,
    frequent_questions)}

CHUNK_ROWS = """
select *, row_number() over (order by n) as chunk_no, doc_id || '-c' || cast(row_number() over (order by n) as string) as chunk_id,
  case when section = '' then content else section || ' ' || content end as searchable from v_chunks
"""
_TOK = TOKENS_SQL.format
_GRAMS = r"""list_distinct(case when length({0}) < 2 then [] else list_transform(
  list_zip(string_split(regexp_replace(lower({0}), '\s+', '', 'g'), ''), string_split(regexp_replace(lower({0}), '\s+', '', 'g'), '')[2:]),
  lambda p: p[1] || p[2]) end)"""


def grams_sql(col):
    return f"list_filter({_GRAMS.format(col)}, lambda x: x is not null)"


def scoring_ctes(name: str, candidates: str, asked: str = "select question_id, question from v_questions") -> dict[str, str]:
    """CTEs ``<name>_scores`` (question_id, chunk_no, bm25, score) over the rows of ``candidates``."""
    p = name
    return {
        f"{p}_asked": asked,
        f"{p}_chunks": f"select chunk_no, len({_TOK('content')}) as content_len, {_TOK('searchable')} as toks, {grams_sql('searchable')} as grams from ({candidates}) c",
        f"{p}_totals": f"select count(*) as n, avg(content_len) as avg_len from {p}_chunks",
        f"{p}_tf": f"select chunk_no, term, dl, count(*) as tf from (select chunk_no, unnest(toks) as term, len(toks) as dl from {p}_chunks) t group by all",
        f"{p}_df": f"select term, count(*) as df from {p}_tf group by term",
        f"{p}_qt": f"select question_id, unnest({_TOK('question')}) as term from {p}_asked",
        f"{p}_bm25": f"""select question_id, chunk_no, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
            / (tf + 1.5 * (0.25 + 0.75 * dl / avg_len))) as bm25
          from {p}_qt join {p}_tf using (term) join {p}_df using (term) cross join {p}_totals group by all""",
        f"{p}_qg": f"select question_id, g, unnest(g) as gram from (select question_id, {grams_sql('question')} as g from {p}_asked) t",
        f"{p}_cg": f"select chunk_no, len(grams) as n_chunk, unnest(grams) as gram from {p}_chunks",
        f"{p}_overlap": f"""select question_id, chunk_no, count(*) / least(max(len(g)), max(n_chunk)) as overlap
          from {p}_qg join {p}_cg using (gram) group by question_id, chunk_no""",
        f"{p}_best": f"select question_id, max(bm25) as best from {p}_bm25 group by 1",
        f"{p}_scores": f"""select question_id, chunk_no, coalesce(bm25, 0) as bm25,
            0.7::double * coalesce(overlap, 0) + 0.3::double * coalesce(case when best > 0 then bm25 / best end, 0) as score
          from {p}_overlap full join {p}_bm25 using (question_id, chunk_no) left join {p}_best using (question_id)""",
        f"{p}_ranked": f"""select *, row_number() over (partition by question_id order by round(score, 9) desc, chunk_no) as rank
          from {p}_scores where score > 0""",
    }


BASE = dict(v_chunks=V.CHUNKS, v_questions=V.QUESTIONS, chunk_rows=CHUNK_ROWS)
_ALL = scoring_ctes("s", "select * from chunk_rows")
_FAQ = scoring_ctes("f", "select * from chunk_rows where category = 'FAQ'")
_POI = scoring_ctes("p", "select * from chunk_rows where category = 'POI'")
_SNIPPET = SNIPPET_SQL.format("content")
_ROWS = dict(v_chunks=V.CHUNKS, chunk_rows=CHUNK_ROWS)

ORACLES = {
    "kb_ingest": V.oracle("select chunk_id, doc_id, category, title, section, cast(length(content) as int) as n_chars from chunk_rows", **_ROWS),
    "chunk_documents": V.oracle("""
      , first as (select doc_id, arg_min(title, n) as doc_title, arg_min(category, n) as doc_category from v_chunks group by 1)
      select chunk_id, doc_id, doc_title, doc_category from chunk_rows join first using (doc_id)""", **_ROWS),
    "kb_replace_category": V.oracle("""
      select chunk_id || case when category = 'FAQ' then '-v2' else '' end as chunk_id, category, section
      from chunk_rows where category <> 'FAQ' or section <> ''""", **_ROWS),
    "kb_counts": V.oracle("""
      select category as name, count(*) as n from v_chunks group by 1 union all select 'total', count(*) from v_chunks
      union all select 'active_sessions', count(distinct conv_id) from conversations""", v_chunks=V.CHUNKS),
    "kb_union": V.oracle("select chunk_id, category from chunk_rows", **_ROWS),
    "material_list": V.oracle(f"""
      select chunk_id, doc_id, section, {_SNIPPET} as snippet, 1.0::double as score from chunk_rows
      where category = 'MATERIAL' and student_category = 'GRADUATE'""", **_ROWS),
    "term_stats": V.oracle(f"""
      , toks as (select chunk_id, unnest({_TOK('searchable')}) as term from chunk_rows)
      select term, count(distinct chunk_id) as df, count(*) as occurrences,
        round(ln(1.0 + ((select count(*) from chunk_rows) - count(distinct chunk_id) + 0.5) / (count(distinct chunk_id) + 0.5)), 6) as idf
      from toks group by term""", **_ROWS),
    "bigram_overlap": f"""
      with g as (select conv_id, turn, {grams_sql('text')} as g from conversations)
      select a.conv_id as session_id, a.turn, cast(len(a.g) as int) as n_grams,
        round(case when least(len(a.g), len(b.g)) > 0 then len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)) else 0 end, 6) as overlap
      from g a join g b on b.conv_id = a.conv_id and b.turn = a.turn + 1""",
    "bm25_scores": V.oracle("""
      select question_id, chunk_no, round(bm25, 6) as bm25, n - count(*) over (partition by question_id) as zero_chunks
      from s_bm25 cross join s_totals""", **BASE, **{k: v for k, v in _ALL.items() if k in
                     ("s_asked", "s_chunks", "s_totals", "s_tf", "s_df", "s_qt", "s_bm25")}),
    "hybrid_topk": V.oracle("""
      select question_id, cast(rank as int) as rank, chunk_id, category, section, round(score, 6) as score
      from s_ranked join chunk_rows using (chunk_no) where rank <= 5""", **BASE, **_ALL),
    "hybrid_topk_poi": V.oracle("""
      select question_id, cast(rank as int) as rank, chunk_id, round(score, 6) as score from p_ranked join chunk_rows using (chunk_no) where rank <= 3""", **BASE, **_POI),
    "retrieval_confidence": V.oracle("""
      select question_id, round(max(score), 6) as top_score, coalesce(max(score), 0) < 0.6 as low_confidence
      from v_questions left join s_scores using (question_id) group by 1""", **BASE, **_ALL),
    "faq_fallback": V.oracle(f"""
      select question_id, coalesce(score >= 0.5, false) as hit,
        case when score >= 0.5 then {_SNIPPET} else '{C.FAQ_FALLBACK_REPLY}' end as reply,
        case when score >= 0.5 then round(score, 6) else 0 end as score
      from v_questions left join (select * from f_ranked where rank = 1) r using (question_id) left join chunk_rows using (chunk_no)""",
        **BASE, **_FAQ),
    "conversation_context": """
      select conv_id as session_id, cast(count(*) as int) as messages, string_agg(role || ': ' || text, chr(10) order by turn) as history
      from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations where role in ('user', 'assistant')) t
      where rn <= 4 group by conv_id""",
    "token_usage": """
      with t as (select conv_id, role, case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end as n from conversations)
      select conv_id as session_id, cast(coalesce(sum(n) filter (role <> 'assistant'), 0) as bigint) as prompt_tokens,
        cast(coalesce(sum(n) filter (role = 'assistant'), 0) as bigint) as completion_tokens, cast(sum(n) as bigint) as total_tokens
      from t group by conv_id""",
    "frequent_questions": V.oracle(f"""
      , asked as (select message from v_messages union all select text from conversations where role = 'user')
      select question, count(*) as times from (select array_to_string({_TOK('message')}, ' ') as question from asked) q
      where question <> '' group by question order by times desc, question limit 20""", v_messages=V.MESSAGES),
}
