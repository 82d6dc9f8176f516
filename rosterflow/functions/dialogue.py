"""Safety verdicts, intents, labels and prompt text as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.functions.text import is_blank

# How an intent marker is written.
MARKER_PATTERN = r"\[\[(STEP|POI):([^\]]+)\]\]"

SafetyRule = tuple[str, list[str], str]


def safety_category(message: Column, rules: Sequence[SafetyRule] = C.SAFETY_RULES) -> Column:
    """First rule set that matches, in order; null when the message passes or is blank."""
    verdict = F.when(is_blank(message), F.lit(None).cast("string"))
    for category, patterns, _ in rules:
        hit = None
        for pattern in patterns:
            hit = message.rlike(pattern) if hit is None else hit | message.rlike(pattern)
        verdict = verdict.when(hit, F.lit(category))
    return verdict


def refusal_text(category: Column, rules: Sequence[SafetyRule] = C.SAFETY_RULES) -> Column:
    reply = F.lit(None).cast("string")
    for name, _, text in rules:
        reply = F.when(category == name, F.lit(text)).otherwise(reply)
    return reply


def _has_any(col: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.coalesce(col.contains(word), F.lit(False))
    return hit


def detect_intent(question: Column, title: Column, section: Column) -> Column:
    """Marker for the first rule that fits the question or its best source; null if none."""
    lowered = F.lower(question)
    marker = F.when(question.isNull(), F.lit(None).cast("string"))
    for words, section_words, title_words, text in C.INTENT_RULES:
        fits = _has_any(lowered, words) | _has_any(section, section_words) | _has_any(title, title_words)
        value = F.lit(text) if text else F.concat(F.lit("[[POI:"), section, F.lit("]]"))
        marker = marker.when(fits, value)
    return marker


def extract_intents(reply: Column) -> Column:
    """Array of (type, target) markers in text order."""
    kinds = F.regexp_extract_all(reply, F.lit(MARKER_PATTERN), F.lit(1))
    targets = F.regexp_extract_all(reply, F.lit(MARKER_PATTERN), F.lit(2))
    pairs = F.zip_with(
        kinds, targets, lambda k, t: F.struct(k.alias("type"), F.trim(t).alias("target")))
    return F.coalesce(pairs, F.array().cast("array<struct<type:string,target:string>>"))


def strip_intents(reply: Column) -> Column:
    return F.coalesce(
        F.regexp_replace(F.regexp_replace(reply, MARKER_PATTERN, ""), r"^\s+|\s+$", ""), F.lit(""))


def intent_tools(intents: Column) -> Column:
    """Tool calls for intent markers."""
    return F.transform(intents, lambda i: F.struct(
        F.when(i["type"] == "STEP", F.lit(C.TOOL_STEP)).otherwise(F.lit(C.TOOL_NAVIGATION)).alias("tool"),
        i["target"].alias("target"),
        F.concat(F.lit(C.TOOL_DISPLAY_PREFIX), i["target"]).alias("display_text"),
    ))


def compose_reply(sources: Column, marker: Column) -> Column:
    """Best snippet, up to two more with their sections, and the intent marker.

    ``sources`` is an ordered array of structs with ``section`` and ``snippet``.
    """
    more = F.transform(
        F.slice(sources, 2, 2), lambda s: F.concat(F.lit("\n"), s["section"], F.lit(":"), s["snippet"]))
    body = F.concat(
        F.element_at(sources, 1)["snippet"],
        F.when(F.size(sources) > 1, F.concat(F.lit(C.MORE_SOURCES_HEADING), F.array_join(more, "")))
        .otherwise(F.lit("")),
        F.coalesce(F.concat(F.lit("\n"), marker), F.lit("")),
    )
    return F.when(F.coalesce(F.size(sources), F.lit(0)) < 1, F.lit(C.NO_SOURCE_REPLY)).otherwise(body)


def cut_reply(reply: Column) -> Column:
    return F.when(
        F.length(reply) > C.MAX_REPLY_LENGTH,
        F.concat(F.left(reply, F.lit(C.MAX_REPLY_LENGTH)), F.lit("...")),
    ).otherwise(reply)


def prompt_context(step: Column, identity: Column) -> Column:
    """Line with the current step and identity, where they are known."""
    return F.concat(
        F.lit(C.PROMPT_CURRENT_HEADING),
        F.coalesce(F.concat(F.lit(C.PROMPT_STEP), step), F.lit("")),
        F.coalesce(F.concat(F.lit(C.PROMPT_IDENTITY), identity), F.lit("")), F.lit("\n"))


def build_prompt(
    sources: Column, history: Column, question: Column, context: Column | None = None,
) -> Column:
    """Instruction block, numbered sources, context, history and question as one text.

    ``sources`` holds structs (title, section, snippet); ``history`` structs
    (role, content); ``context`` is a :func:`prompt_context` line or null.
    """
    numbered = F.transform(sources, lambda s, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] 来源:"), s["title"], F.lit(" / 章节:"), s["section"],
        F.lit("\n内容:"), s["snippet"], F.lit("\n\n")))
    no_sources = F.coalesce(F.size(sources), F.lit(0)) < 1
    turns = F.transform(
        history, lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.lit("\n")))
    no_history = F.coalesce(F.size(history), F.lit(0)) < 1
    return F.concat(
        F.lit(C.SYSTEM_PROMPT + C.PROMPT_CONTEXT_HEADING),
        F.when(no_sources, F.lit(C.PROMPT_NO_SOURCES)).otherwise(F.array_join(numbered, "")),
        F.lit("") if context is None else F.coalesce(context, F.lit("")),
        F.when(no_history, F.lit("")).otherwise(
            F.concat(F.lit(C.PROMPT_HISTORY_HEADING), F.array_join(turns, ""))),
        F.lit(C.PROMPT_QUESTION_HEADING), question,
    )


def content_label(degraded: Column) -> Column:
    """Visible label of a reply; the FAQ mode marks it as degraded."""
    def label(values) -> Column:
        kind, text, flag, mode = values
        return F.struct(
            F.lit(True).alias("is_ai_generated"), F.lit(kind).alias("label_type"),
            F.lit(text).alias("label_text"), F.lit(flag).alias("degraded"),
            F.lit(mode).cast("string").alias("degrade_mode"))

    return F.when(degraded, label(C.LABEL_FAQ)).otherwise(label(C.LABEL_NORMAL))
