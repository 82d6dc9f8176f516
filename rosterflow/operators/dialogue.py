"""Conversation history, token use and question reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterflow import constants as C
from rosterflow.functions import text


def recent_history(turns: DataFrame, rounds: int = C.HISTORY_ROUNDS) -> DataFrame:
    """Last ``rounds`` rounds (two messages each) per session, oldest first.

    The rank filter limits each task's output before the shuffle, and the array
    holds at most ``2 * rounds`` messages.
    """
    newest = W.partitionBy("session_id").orderBy(F.col("turn").desc())
    spoken = turns.filter(F.col("role").isin("user", "assistant"))
    recent = spoken.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= 2 * rounds)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return recent.groupBy("session_id").agg(F.transform(
        ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))


def token_usage(turns: DataFrame) -> DataFrame:
    """Prompt, completion and total tokens per session."""
    size = text.estimate_tokens(F.col("content")).cast("bigint")
    return turns.groupBy("session_id").agg(
        F.coalesce(F.sum(F.when(F.col("role") != "assistant", size)), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum(F.when(F.col("role") == "assistant", size)), F.lit(0)).alias("completion_tokens"),
        F.sum(size).alias("total_tokens"))


def call_usage(calls: DataFrame) -> DataFrame:
    """Prompt, completion and total tokens of every call with ``prompt`` and ``completion`` texts (null: none)."""
    sizes = {f"{part}_tokens": text.estimate_tokens(F.col(part)).cast("bigint") for part in ("prompt", "completion")}
    return calls.withColumns(sizes).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def daily_usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens by student and day, from the rows of :func:`call_usage`."""
    sums = [F.sum(f"{part}_tokens").alias(f"{part}_tokens") for part in ("prompt", "completion", "total")]
    return calls.groupBy("student_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("calls"), *sums)


def frequent_questions(messages: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent normalised questions; equal texts are counted before the shuffle."""
    asked = messages.select(text.normalise_question(F.col("message")).alias("question"))
    return (
        asked.filter(F.col("question") != "").groupBy("question").agg(F.count(F.lit(1)).alias("times"))
        .orderBy(F.col("times").desc(), "question").limit(k)
    )
