"""The chat job: limit per student, session history, answering, the round added to the history, tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.operators import limits
from rosterflow.plans import answering

RATE_LIMITED = "rate_limited"


def chat_turns(
    requests: DataFrame, chunks: DataFrame, history: DataFrame, max_requests: int = C.CHAT_LIMIT_PER_MINUTE,
    window_seconds: int = 60, **workflow,
) -> DataFrame:
    """One row for each request: its outcome, or the refusal of the limiter and the seconds to wait.

    ``requests`` carries question_id, seq, ts, student_id, session_id, question and ``available``; ``history`` one array of
    messages for each question.  A refused request counts against the limit, reaches neither retrieval nor the
    generator, and uses no tokens.
    """
    limited = limits.anchored_window(
        requests.select("seq", "ts", "student_id"), "student_id", max_requests, window_seconds)
    judged = requests.join(limited.select("seq", "allowed", "remaining", "retry_after"), "seq")
    asked = judged.filter("allowed").select("question_id", "question", "available")
    answered = answering.answer(asked, chunks, history, **workflow).select(
        "question_id", "mode", "reply", "intents", "tools", "label", "low_confidence", "transfer_to_human", "prompt_tokens",
        "completion_tokens")
    no_tokens = {f"{part}_tokens": F.coalesce(f"{part}_tokens", F.lit(0)) for part in ("prompt", "completion")}
    return judged.join(answered, "question_id", "left").withColumns({
        "mode": F.coalesce("mode", F.lit(RATE_LIMITED)), **no_tokens})


def appended_rounds(turns: DataFrame) -> DataFrame:
    """Messages that answered requests add to their sessions: the question as asked, then the reply, in order of ``turn``."""
    parts = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("user").alias("role"), F.col("question").alias("content")),
        F.struct(F.lit(1).alias("step"), F.lit("assistant").alias("role"), F.col("reply").alias("content")))
    spoken = turns.filter(F.col("mode") != RATE_LIMITED).select("session_id", "seq", F.explode(parts).alias("m"))
    return spoken.select("session_id", (F.col("seq") * 2 + F.col("m.step")).alias("turn"), "m.role", "m.content")
