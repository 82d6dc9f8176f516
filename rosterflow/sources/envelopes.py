"""Domain-event envelopes: parsing, validation and publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.functions.times import instant_text, parse_time

ENVELOPE_SCHEMA = (
    "eventId string, eventType string, eventTime string, source string, traceId string, "
    "version string, payload string, retryCount int"
)

# Payload fields per event type.
PAYLOAD_SCHEMAS = {
    C.CHECKIN_SUCCESS: "studentId string, idCard string, name string, checkinTime string, checkinPoint string",
    C.PAYMENT_COMPLETED: (
        "studentId string, idCard string, name string, gender string, collegeCode string, dormBuilding string, "
        "roomNo string, bedNo string, payOrderNo string, payAmount decimal(12,2), payMethod string"),
    C.VERIFIED_SUCCESS: (
        "studentId string, idCard string, name string, collegeCode string, photoUrl string, issueType string"),
    C.CHECKIN_COMPLETED: (
        "studentId string, idCard string, name string, collegeCode string, classNo string, counselorId string, "
        "completedTime string"),
}


def student_id_of(payload: Column, default: str | None = "unknown") -> Column:
    """Student id of a JSON payload; consumers fall back to "unknown", the notifier to null."""
    found = F.get_json_object(payload, "$.studentId")
    return found if default is None else F.coalesce(found, F.lit(default))


def parse_envelopes(raw: DataFrame, value: str = "value") -> DataFrame:
    """Envelopes from a JSON column, with defaults and a mark on unknown event types."""
    kept = [c for c in raw.columns if c != value]
    parsed = raw.withColumn("__e", F.from_json(F.col(value), ENVELOPE_SCHEMA))
    kind = F.col("__e.eventType")
    return parsed.select(
        *kept,
        F.col("__e.eventId").alias("event_id"),
        kind.alias("event_type"),
        parse_time(F.col("__e.eventTime")).alias("event_time"),
        F.col("__e.source").alias("source"),
        F.col("__e.traceId").alias("trace_id"),
        F.coalesce(F.col("__e.version"), F.lit("1.0")).alias("version"),
        F.col("__e.payload").alias("payload"),
        F.coalesce(F.col("__e.retryCount"), F.lit(0)).alias("retry_count"),
        student_id_of(F.col("__e.payload")).alias("student_id"),
        F.coalesce(kind.isin(C.EVENT_TYPES), F.lit(False)).alias("known_type"),
    )


def payload_of(event_type: str, payload: str = "payload") -> Column:
    """Typed payload of one event type."""
    return F.from_json(F.col(payload), PAYLOAD_SCHEMAS[event_type])


def publish_rows(envelopes: DataFrame) -> DataFrame:
    """Key, value and headers of messages, in the shape the Kafka writer takes.

    The routing key is the event type; the JSON payload stays a nested object; the
    retry count travels as a header.
    """
    return envelopes.select(
        F.col("event_type").alias("key"), _body().alias("value"),
        F.array(_header("message-id", F.col("event_id")), _header(C.HEADER_RETRY_COUNT, F.col("retry_count")))
        .alias("headers"))


def retry_rows(envelopes: DataFrame) -> DataFrame:
    """Exchange, key, value and headers of messages that go to a retry queue or the dead letters.

    ``envelopes`` carries the ``queue`` that consumed it, the ``retry_count`` it was consumed with, and the ``action`` and
    ``reason`` of that; other actions send nothing.  A retry counts one more.
    """
    again = F.col("action") == "RETRY"
    sent = envelopes.filter(F.col("action").isin("RETRY", "DEAD_LETTER")).withColumn(
        "retry_count", F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")).cast("int"))
    count = _header(C.HEADER_RETRY_COUNT, F.col("retry_count"))
    headers = F.when(again, F.array(
        count, _header(C.HEADER_QUEUE, F.col("queue")), _header(C.HEADER_ROUTING_KEY, F.col("event_type"))
    )).otherwise(F.array(_header(C.HEADER_REASON, F.col("reason")), count))
    return sent.select(
        F.when(again, F.lit(C.RETRY_EXCHANGE)).otherwise(F.lit(C.DEAD_LETTER_EXCHANGE)).alias("exchange"),
        F.when(again, F.concat(F.lit("retry."), F.col("retry_count").cast("string"))).otherwise(
            F.col("event_type")).alias("key"),
        _body().alias("value"), headers.alias("headers"))


def _header(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), F.encode(value.cast("string"), "utf-8").alias("value"))


def _body() -> Column:
    return F.to_json(F.struct(
        F.col("event_id").alias("eventId"), F.col("event_type").alias("eventType"),
        instant_text(F.col("event_time")).alias("eventTime"),
        F.col("source"), F.col("trace_id").alias("traceId"), F.col("version"),
        F.try_parse_json("payload").alias("payload"), F.col("retry_count").alias("retryCount")))
