"""Batch question answering over a table of questions and a chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.functions import dialogue, privacy, text
from rosterflow.operators import retrieval
from rosterflow.session import written

Retriever = Callable[[DataFrame, DataFrame, int, "str | None"], DataFrame]
Generator = Callable[[DataFrame], DataFrame]


def sources_per_question(found: DataFrame) -> DataFrame:
    """Ranked sources as one array per question (at most K entries, so the retriever must have been given a K)."""
    entry = F.struct("rank", "doc_id", "title", "section", "snippet", "score", "category")
    return found.groupBy("question_id").agg(F.array_sort(F.collect_list(entry)).alias("sources"))


def extractive(asked: DataFrame) -> DataFrame:
    """Default generator: reply composed from the sources; adds ``raw_reply``."""
    top = F.element_at("sources", 1)
    marker = dialogue.detect_intent(F.col("masked_question"), top["title"], top["section"])
    return asked.withColumn("raw_reply", dialogue.compose_reply(F.col("sources"), marker))


def with_sources(
    questions: DataFrame, chunks: DataFrame, k: int = C.TOP_K, retriever: Retriever = retrieval.retrieve,
) -> DataFrame:
    """Questions with their sources, masked text and top score."""
    return _sourced(questions, sources_per_question(retriever(questions.select("question_id", "question"), chunks, k, None)))


def _sourced(questions: DataFrame, found: DataFrame) -> DataFrame:
    return questions.join(found, "question_id", "left").withColumns({
        "masked_question": privacy.mask_placeholders(F.col("question")),
        "top_score": F.coalesce(F.try_element_at("sources", F.lit(1))["score"], F.lit(0.0)),
    })


def with_prompt(asked: DataFrame, history: DataFrame) -> DataFrame:
    """Adds the prompt text; ``history`` holds one message array per question."""
    return asked.join(history, "question_id", "left").withColumn(
        "prompt", dialogue.build_prompt(F.col("sources"), F.col("history"), F.col("masked_question")))


def answer(
    questions: DataFrame, chunks: DataFrame, history: DataFrame,
    generator: Generator = extractive, retriever: Retriever = retrieval.retrieve,
    safety_rules=C.SAFETY_RULES, fallback: Callable[[DataFrame, DataFrame], DataFrame] = retrieval.faq_fallback,
) -> DataFrame:
    """One outcome per question, in the order refusal, low confidence, generated answer, FAQ fallback.

    Refused questions are not looked up, and the FAQ is asked only for those that end there.

    ``questions`` carries question_id, question and ``available`` (whether the
    generator can be used).
    """
    judged = questions.withColumn(
        "violation", dialogue.safety_category(F.col("question"), safety_rules))
    allowed = judged.filter(F.col("violation").isNull())
    found = written(sources_per_question(retriever(allowed.select("question_id", "question"), chunks, C.TOP_K, None)), "sources")
    asked = generator(with_prompt(_sourced(judged, found), history))
    sure = found.filter(F.element_at("sources", 1)["score"] >= C.LOW_CONFIDENCE_THRESHOLD).select("question_id")
    degraded_questions = allowed.filter(~F.col("available")).join(sure, "question_id", "left_semi").select(
        "question_id", privacy.mask_placeholders(F.col("question")).alias("question"))
    faq = fallback(degraded_questions, chunks).select(
        "question_id", F.col("reply").alias("faq_reply"), F.col("hit").alias("faq_hit"))
    joined = asked.join(faq, "question_id", "left")
    blocked = F.col("violation").isNotNull()
    unsure = F.col("top_score") < C.LOW_CONFIDENCE_THRESHOLD
    mode = (
        F.when(blocked, F.lit("refused")).when(unsure, F.lit("low_confidence"))
        .when(F.col("available"), F.lit("generated")).otherwise(F.lit("faq")))
    generated = F.col("mode") == "generated"
    prompt_tokens = F.when(generated, text.estimate_tokens(F.col("prompt"))).otherwise(F.lit(0))
    reply_tokens = F.when(generated, text.estimate_tokens(F.col("raw_reply"))).otherwise(F.lit(0))
    no_intents = F.array().cast("array<struct<type:string,target:string>>")
    return joined.withColumn("mode", mode).withColumns({
        "reply": F.when(F.col("mode") == "refused", dialogue.refusal_text(F.col("violation"), safety_rules))
        .when(F.col("mode") == "low_confidence", F.lit(C.LOW_CONFIDENCE_REPLY))
        .when(generated, dialogue.cut_reply(dialogue.strip_intents(F.col("raw_reply"))))
        .otherwise(F.col("faq_reply")),
        "intents": F.when(generated, dialogue.extract_intents(F.col("raw_reply"))).otherwise(no_intents),
        "label": dialogue.content_label(F.col("mode") == "faq"),
        "transfer_to_human": F.coalesce(F.col("violation") == "self_harm", F.lit(False)),
        "low_confidence": F.when(F.col("mode") == "faq", ~F.col("faq_hit")).otherwise(
            F.col("mode") == "low_confidence"),
        "prompt_tokens": prompt_tokens,
        "completion_tokens": reply_tokens,
    }).withColumn("tools", dialogue.intent_tools(F.col("intents")))
