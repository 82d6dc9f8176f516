"""Latency monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterflow import constants as C


def average_latency(samples: DataFrame, by: str, latency: str) -> DataFrame:
    """Whole milliseconds per group, 0 when there is no sample."""
    return samples.groupBy(by).agg(
        F.count(latency).alias("writes"),
        F.coalesce(F.expr(f"sum({latency}) div count({latency})"), F.lit(0)).cast("bigint")
        .alias("avg_latency_ms"),
    )


def latest_samples(samples: DataFrame, by: str, seq: str, size: int = C.LATENCY_WINDOW) -> DataFrame:
    """The ``size`` newest rows per group.

    Spark turns the rank filter into a per-task limit before the shuffle, so a
    hot group sends at most ``size`` rows from each task.
    """
    newest = W.partitionBy(by).orderBy(F.col(seq).desc())
    return samples.withColumn("__rn", F.row_number().over(newest)).filter(
        F.col("__rn") <= size).drop("__rn")


def nearest_rank(sorted_values: Column, percent: int) -> Column:
    """Value at rank ceil(percent / 100 * n) of a sorted array, 0 when it is empty."""
    size = F.size(sorted_values)
    rank = F.greatest(F.lit(1), F.ceil(F.lit(percent / 100.0) * size).cast("int"))
    return F.when(size > 0, F.element_at(sorted_values, F.least(rank, size))).otherwise(F.lit(0))


def latency_percentiles(samples: DataFrame, by: str, seq: str, latency: str) -> DataFrame:
    """P95, P99 and the health flag over the newest samples of each group.

    The array holds at most :data:`rosterflow.constants.LATENCY_WINDOW` values.
    """
    frame = latest_samples(samples.select(by, seq, latency), by, seq)
    grouped = frame.groupBy(by).agg(F.sort_array(F.collect_list(latency)).alias("v"))
    return grouped.select(
        by,
        F.size("v").cast("bigint").alias("samples"),
        nearest_rank(F.col("v"), 95).cast("bigint").alias("p95_ms"),
        nearest_rank(F.col("v"), 99).cast("bigint").alias("p99_ms"),
    ).withColumn("healthy", F.col("p95_ms") <= C.P95_TARGET_MS)


def observed(handled: DataFrame, name: str = "sync") -> tuple[DataFrame, Observation]:
    """The rows, and counters that the first action on them fills in passing, without a pass of their own.

    The counters are those of ``changes.sync_stats`` over all sources.
    """
    counters = Observation(name)
    outcome = F.col("outcome")
    failed = outcome.isin(C.DEAD_LETTER, C.MAPPING_MISSING, C.RETRY_EXHAUSTED)
    return handled.observe(
        counters, F.count(F.lit(1)).alias("total_events"), F.count_if(outcome == C.SUCCESS).alias("success_count"),
        F.count_if(failed).alias("failure_count"), F.count_if(failed).alias("dead_letter_count"),
        F.count_if(outcome == C.SKIPPED_DUPLICATE).alias("skipped_count")), counters
