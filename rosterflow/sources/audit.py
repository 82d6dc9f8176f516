"""Append-only log of tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterflow.functions.privacy import mask_params


# A log without any call has no file that would tell its columns.
CALLS = ("log_id string, tool_name string, student_id string, params map<string,string>, success boolean, "
         "error_code string, ts timestamp_ntz, day date")


def append_calls(outcomes: DataFrame, path: str) -> None:
    """Appends call outcomes with masked parameters, one folder per day."""
    logged = outcomes.select(
        F.concat(F.lit("log-"), F.col("seq").cast("string")).alias("log_id"), "tool_name", "student_id",
        mask_params(F.col("params")).alias("params"), "success", "error_code", "ts",
        F.to_date("ts").alias("day"))
    logged.write.mode("append").partitionBy("day").parquet(path)


def all_calls(spark: SparkSession, path: str) -> DataFrame:
    """The whole log."""
    return spark.read.schema(CALLS).parquet(path)


def calls_of(spark: SparkSession, path: str, student_id: str) -> DataFrame:
    """All logged calls of one student; the filter reaches the scan."""
    return all_calls(spark, path).filter(F.col("student_id") == student_id)
