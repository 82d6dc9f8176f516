"""Intent, reply, prompt and answer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.catalog import retrieval as R
from rosterflow.catalog import views as V
from rosterflow.catalog.privacy import SNIPPET_SQL, _REFUSAL, _placeholder_sql, safety_sql
from rosterflow.functions import dialogue
from rosterflow.operators import dialogue as turns_ops
from rosterflow.plans import answering, chat


def intent_detect(spark, sf):
    typed = V.view(spark, sf, V.MESSAGES).select(
        F.concat(F.lit("m"), "message_id").alias("id"), "message", F.lit("").alias("title"), F.lit("").alias("section"))
    sections = R.sections(spark, sf).select(
        F.concat(F.lit("c"), "n").alias("id"), F.col("content").alias("message"), "title", "section")
    marker = dialogue.detect_intent(F.col("message"), F.col("title"), F.col("section"))
    return typed.unionByName(sections).select("id", marker.alias("marker"))


def _marked_replies(spark, sf):
    tail = F.when(F.col("message").contains("学费"), "去这里 [[STEP: payment ]]\n").when(
        F.col("message").contains("图书馆"), "[[POI:中心图书馆]] 和 [[POI:第一食堂]]").otherwise("[[OTHER:x]] ")
    return V.view(spark, sf, V.MESSAGES).select("message_id", F.concat(F.lit("  "), F.col("message"), tail).alias("reply"))


def intent_extract(spark, sf):
    found = _marked_replies(spark, sf).select(
        "message_id", dialogue.strip_intents(F.col("reply")).alias("shown"),
        F.posexplode_outer(dialogue.extract_intents(F.col("reply"))).alias("i", "intent"))
    return found.select("message_id", "shown", "i", "intent.type", "intent.target")


def intent_tools(spark, sf):
    tools = dialogue.intent_tools(dialogue.extract_intents(F.col("reply")))
    return _marked_replies(spark, sf).select("message_id", F.posexplode(tools).alias("i", "t")).select(
        "message_id", "i", "t.tool", "t.target", "t.display_text")


def _history(spark, sf):
    return turns_ops.recent_history(R.turns(spark, sf), rounds=2).withColumnRenamed("session_id", "question_id")


def extractive_reply(spark, sf):
    rows, found = R.lookup(spark, sf)
    asked = answering.with_sources(R.questions(spark, sf), rows, retriever=found["retriever"])
    return answering.extractive(asked).select("question_id", "raw_reply")


def prompt_build(spark, sf):
    rows, found = R.lookup(spark, sf)
    asked = answering.with_sources(R.questions(spark, sf), rows, retriever=found["retriever"])
    return answering.with_prompt(asked, _history(spark, sf)).select("question_id", "prompt")


def qa_outcomes(spark, sf):
    rows, found = R.lookup(spark, sf)
    done = answering.answer(R.questions(spark, sf), rows, _history(spark, sf), **found)
    listed = F.transform("intents", lambda i: F.concat(i["type"], F.lit(":"), i["target"]))
    return done.select(
        "question_id", "mode", "violation", "reply", F.array_join(listed, ",").alias("intents"),
        "prompt_tokens", "completion_tokens", "transfer_to_human", "low_confidence",
        F.col("label.label_type").alias("label_type"), F.col("label.degraded").alias("degraded"))


def chat_turns(spark, sf):
    """The questions as a chat of three students; rounds are counted as they are added to the sessions."""
    requests = R.questions(spark, sf).withColumns({
        "seq": F.col("question_id"), "ts": F.timestamp_millis(F.col("question_id") * 2000).cast("timestamp_ntz"),
        "student_id": (F.col("question_id") % 3).cast("string"), "session_id": F.col("question_id") % 5})
    rows, found = R.lookup(spark, sf)
    done = chat.chat_turns(requests, rows, _history(spark, sf), max_requests=5, **found)
    rounds = chat.appended_rounds(done).groupBy("session_id").agg(F.count(F.lit(1)).alias("added"))
    return done.join(rounds, "session_id", "left").select(
        "question_id", "student_id", "allowed", "retry_after", "mode", "reply", "prompt_tokens", "completion_tokens",
        F.coalesce(F.size("tools"), F.lit(0)).cast("int").alias("tool_calls"), "added")


def _calls(spark, sf):
    reply = dialogue.refusal_text(dialogue.safety_category(F.col("message")))
    return turns_ops.call_usage(V.view(spark, sf, V.MESSAGES).select(
        "message_id", "student_id", "ts", F.col("message").alias("prompt"), reply.alias("completion")))


def call_usage(spark, sf):
    return _calls(spark, sf).select("message_id", "prompt_tokens", "completion_tokens", "total_tokens")


def daily_usage(spark, sf):
    return turns_ops.daily_usage(_calls(spark, sf))


QUERIES = {fn.__name__: fn for fn in (
    intent_detect, intent_extract, intent_tools, extractive_reply, prompt_build, qa_outcomes, chat_turns, call_usage,
    daily_usage)}


def _contains_sql(col, words):
    return " or ".join(f"contains({col}, '{w}')" for w in words) or "false"


def _intent_sql(question, title, section):
    whens = []
    for words, section_words, title_words, marker in C.INTENT_RULES:
        fits = " or ".join(f"({x})" for x in (
            _contains_sql(f"lower({question})", words), _contains_sql(section, section_words), _contains_sql(title, title_words)))
        value = f"'{marker}'" if marker else f"'[[POI:' || {section} || ']]'"
        whens.append(f"when {fits} then {value}")
    return "case " + " ".join(whens) + " end"


_MARKED = """
select message_id, '  ' || message || case when contains(message, '学费') then '去这里 [[STEP: payment ]]' || chr(10)
  when contains(message, '图书馆') then '[[POI:中心图书馆]] 和 [[POI:第一食堂]]' else '[[OTHER:x]] ' end as reply from v_messages
"""
_SHOWN = r"regexp_replace(regexp_replace(reply, '\[\[(STEP|POI):([^\]]+)\]\]', '', 'g'), '^\s+|\s+$', '', 'g')"
_LISTED = r"""
select message_id, reply, generate_subscripts(k, 1) as pos, unnest(k) as type, trim(unnest(t)) as target from (
  select message_id, reply, regexp_extract_all(reply, '\[\[(STEP|POI):([^\]]+)\]\]', 1) as k,
    regexp_extract_all(reply, '\[\[(STEP|POI):([^\]]+)\]\]', 2) as t from marked) x
"""
_MASKED = f"select *, {_placeholder_sql('question')} as masked_question from v_questions"
_FOUND = f"""
select question_id, rank, score, title, section, {SNIPPET_SQL.format('content')} as snippet
from s_ranked join chunk_rows using (chunk_no) where rank <= 5
"""
_REPLIES = f"""
select q.question_id, case when t.question_id is null then '{C.NO_SOURCE_REPLY}' else t.snippet
    || coalesce('{C.MORE_SOURCES_HEADING}' || (select string_agg(chr(10) || m.section || ':' || m.snippet, '' order by m.rank)
         from found m where m.question_id = q.question_id and m.rank in (2, 3)), '')
    || coalesce(chr(10) || {_intent_sql('q.masked_question', 't.title', 't.section')}, '') end as raw_reply
from masked q left join found t on t.question_id = q.question_id and t.rank = 1
"""
_PROMPTS = f"""
select q.question_id, '{C.SYSTEM_PROMPT}{C.PROMPT_CONTEXT_HEADING}' || coalesce((
    select string_agg('[' || cast(m.rank as string) || '] 来源:' || m.title || ' / 章节:' || m.section || chr(10) || '内容:' || m.snippet
      || chr(10) || chr(10), '' order by m.rank) from found m where m.question_id = q.question_id), '{C.PROMPT_NO_SOURCES}')
  || coalesce('{C.PROMPT_HISTORY_HEADING}' || (select string_agg(h.role || ': ' || h.text || chr(10), '' order by h.turn)
       from recent h where h.conv_id = q.question_id), '')
  || '{C.PROMPT_QUESTION_HEADING}' || q.masked_question as prompt
from masked q
"""
_RECENT = """
select * from (select *, row_number() over (partition by conv_id order by turn desc) as rn from conversations
  where role in ('user', 'assistant')) t where rn <= 4
"""
_BASE = {**R.BASE, **R._ALL, "masked": _MASKED, "found": _FOUND}
_FAQ_CTES = R.scoring_ctes(
    "f", "select * from chunk_rows where category = 'FAQ'", "select question_id, masked_question as question from masked")
_SIZE = "case when length({0}) = 0 then 0 else greatest(1, length({0}) // 4) end"

ORACLES = {
    "intent_detect": V.oracle(f"""
      select 'm' || cast(message_id as string) as id, {_intent_sql('message', "''", "''")} as marker from v_messages
      union all select 'c' || cast(n as string), {_intent_sql('content', 'title', 'section')} from v_chunks""",
        v_messages=V.MESSAGES, v_chunks=V.CHUNKS),
    "intent_extract": V.oracle(f"""
      select m.message_id, {_SHOWN.replace('reply', 'm.reply', 1)} as shown, cast(l.pos - 1 as int) as i, l.type, l.target
      from marked m left join listed l on l.message_id = m.message_id""", v_messages=V.MESSAGES, marked=_MARKED, listed=_LISTED),
    "intent_tools": V.oracle(f"""
      select message_id, cast(pos - 1 as int) as i, case when type = 'STEP' then '{C.TOOL_STEP}' else '{C.TOOL_NAVIGATION}' end as tool,
        target, '{C.TOOL_DISPLAY_PREFIX}' || target as display_text from listed""", v_messages=V.MESSAGES, marked=_MARKED, listed=_LISTED),
    "extractive_reply": V.oracle("select question_id, raw_reply from replies", **_BASE, replies=_REPLIES),
    "prompt_build": V.oracle("select question_id, prompt from prompts", **_BASE, recent=_RECENT, prompts=_PROMPTS),
    "qa_outcomes": V.oracle(f"""
      , judged as (select m.*, {safety_sql('question')} as category, coalesce(f.score, 0) as top_score
          from masked m left join found f on f.question_id = m.question_id and f.rank = 1),
        moded as (select *, case when category is not null then 'refused' when top_score < 0.6 then 'low_confidence'
          when available then 'generated' else 'faq' end as mode from judged),
        faq as (select question_id, score >= 0.5 as hit, {SNIPPET_SQL.format('content')} as snippet
          from f_ranked join chunk_rows using (chunk_no) where rank = 1),
        stripped as (select question_id, raw_reply, {_SHOWN.replace('reply', 'raw_reply', 1)} as shown,
          regexp_extract_all(raw_reply, '\\[\\[((STEP|POI):[^\\]]+)\\]\\]', 1) as marks from replies)
      select question_id, mode, category as violation, case mode when 'refused' then {_REFUSAL}
          when 'low_confidence' then '{C.LOW_CONFIDENCE_REPLY}'
          when 'generated' then case when length(shown) > 500 then substr(shown, 1, 500) || '...' else shown end
          else case when hit then snippet else '{C.FAQ_FALLBACK_REPLY}' end end as reply,
        case when mode = 'generated' then array_to_string(marks, ',') else '' end as intents,
        cast(case when mode = 'generated' then {_SIZE.format('prompt')} else 0 end as int) as prompt_tokens,
        cast(case when mode = 'generated' then {_SIZE.format('raw_reply')} else 0 end as int) as completion_tokens,
        coalesce(category = 'self_harm', false) as transfer_to_human,
        case when mode = 'faq' then not coalesce(hit, false) else mode = 'low_confidence' end as low_confidence,
        case when mode = 'faq' then 'faq_mode' else 'ai_content' end as label_type, mode = 'faq' as degraded
      from moded join stripped using (question_id) join prompts using (question_id) left join faq using (question_id)""",
        **_BASE, replies=_REPLIES, recent=_RECENT, prompts=_PROMPTS, **_FAQ_CTES),
}

_CHAT = f"""
with recursive qa as ({ORACLES['qa_outcomes']}),
asked as (
  select item_id as id, item_id % 3 as student, item_id * 2000 as ms, row_number() over (partition by item_id % 3 order by item_id) as i
  from benchmark),
opened as (
  select id, student, i, ms, ms as start_ms, 1 as used from asked where i = 1
  union all
  select n.id, n.student, n.i, n.ms, case when n.ms - o.start_ms > 60000 then n.ms else o.start_ms end,
    case when n.ms - o.start_ms > 60000 then 1 else o.used + 1 end
  from opened o join asked n on n.student = o.student and n.i = o.i + 1),
judged as (
  select o.*, used <= 5 as allowed, case when used <= 5 then qa.mode else 'rate_limited' end as chat_mode, qa.*
  from opened o join qa on qa.question_id = o.id),
added as (select question_id % 5 as session, 2 * count(*) as n from judged where allowed group by 1)
select question_id, cast(student as string) as student_id, allowed,
  case when allowed then 0 else (start_ms + 60000 - ms) // 1000 + 1 end as retry_after, chat_mode as mode,
  case when allowed then reply end as reply, cast(case when allowed then prompt_tokens else 0 end as int) as prompt_tokens,
  cast(case when allowed then completion_tokens else 0 end as int) as completion_tokens,
  cast(case when allowed and intents <> '' then len(string_split(intents, ',')) else 0 end as int) as tool_calls, added.n as added
from judged left join added on added.session = question_id % 5"""
ORACLES["chat_turns"] = _CHAT
_USAGE = f"""
, judged as (select *, {safety_sql('message')} as category from v_messages),
 used as (select message_id, student_id, ts, cast({_SIZE.format('message')} as bigint) as prompt_tokens,
   cast(case when category is null then 0 else {_SIZE.format(f'({_REFUSAL})')} end as bigint) as completion_tokens from judged)
"""
ORACLES["call_usage"] = V.oracle(
    _USAGE + "select message_id, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens as total_tokens from used",
    v_messages=V.MESSAGES)
ORACLES["daily_usage"] = V.oracle(_USAGE + """
  select student_id, cast(ts as date) as day, count(*) as calls, cast(sum(prompt_tokens) as bigint) as prompt_tokens,
    cast(sum(completion_tokens) as bigint) as completion_tokens,
    cast(sum(prompt_tokens + completion_tokens) as bigint) as total_tokens
  from used group by 1, 2""", v_messages=V.MESSAGES)
