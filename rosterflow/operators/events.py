"""Domain-event operators: fan-out, idempotent consumption, retries, expiry, chains, notices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.operators import blocks, limits
from rosterflow.operators.joins import first_positions, fixed_table, keep_first, lookup

Handler = Callable[[DataFrame], Column]


def fan_out(events: DataFrame) -> DataFrame:
    """One row per queue bound to the event type; unbound events have none."""
    bindings = fixed_table(events.sparkSession, C.BINDINGS, "event_type string, queue string")
    return events.join(bindings, "event_type")


def dedupe(events: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """First delivery per key."""
    return keep_first(events, keys, seq)


def dedupe_horizon(
    events: DataFrame, key: str, hours: int = C.IDEMPOTENT_HOURS, ts: str = "ts", seq: str = "seq",
) -> DataFrame:
    """Deliveries that idempotence lets pass when a key is remembered for ``hours`` from the delivery that passed.

    A copy within that time is dropped and does not prolong it; the next one after it passes again.
    """
    return limits.first_in_horizon(events, key, hours * 3_600_000, ts, seq).filter("accepted").drop("accepted")


def retry_delay(attempt: Column) -> Column:
    """Seconds before a retry; the last step of the ladder repeats."""
    ladder = F.array(*[F.lit(d) for d in C.RETRY_DELAYS_SECONDS])
    return F.element_at(ladder, F.least(attempt, F.lit(len(C.RETRY_DELAYS_SECONDS))).cast("int"))


def apply_handlers(deliveries: DataFrame, handlers: dict[str, Handler]) -> DataFrame:
    """``handler_result`` per queue from registered functions; queues without one succeed."""
    result = F.lit("OK")
    for queue, handler in handlers.items():
        result = F.when(F.col("queue") == queue, handler(deliveries)).otherwise(result)
    return deliveries.withColumn("handler_result", result)


# A retried message keeps its id, so the retry count is part of the key.
DELIVERY = ["queue", "event_id", "retry_count"]


def mark_copies(deliveries: DataFrame, seq: str = "seq") -> DataFrame:
    """``copy``: whether an earlier delivery has the same queue, id and retry count."""
    copies = first_positions(deliveries, DELIVERY, seq, "first_seq")
    again = F.coalesce(F.col(seq) > F.col("first_seq"), F.lit(False))
    return deliveries.join(copies, DELIVERY, "left").withColumn("copy", again).drop("first_seq")


def consume(deliveries: DataFrame, seq: str = "seq") -> DataFrame:
    """Outcome of every delivery: DUPLICATE, OK, RETRY with its due time, or DEAD_LETTER with a reason.

    ``deliveries`` carries queue, event_id, retry_count, ts and handler_result.
    """
    return planned(mark_copies(deliveries, seq))


def planned(marked: DataFrame) -> DataFrame:
    """Outcomes of deliveries whose copies are marked; the handler's result of a copy does not count."""
    again, result, tries = F.col("copy"), F.col("handler_result"), F.col("retry_count")
    exhausted = tries >= C.MAX_RETRY_COUNT
    action = (
        F.when(again, F.lit("DUPLICATE")).when(result == "OK", F.lit("OK"))
        .when(result == "NON_RETRYABLE", F.lit("DEAD_LETTER"))
        .when(exhausted, F.lit("DEAD_LETTER")).otherwise(F.lit("RETRY"))
    )
    decided = marked.withColumn("action", action).drop("copy")
    is_retry = F.col("action") == "RETRY"
    next_try = F.when(is_retry, (tries + 1).cast("int"))
    delay = F.when(is_retry, retry_delay(next_try))
    reason = F.when(F.col("action") == "DEAD_LETTER", F.when(
        result == "NON_RETRYABLE", F.concat(F.lit("NonRetryableException: "), result)).otherwise(
        F.concat(F.lit("MaxRetryExceeded: retryCount="), tries.cast("string"), F.lit(", lastError="), result)))
    return decided.withColumns({
        "next_retry": next_try,
        "retry_key": F.when(is_retry, F.concat(F.lit("retry."), next_try.cast("string"))),
        "delay_seconds": delay,
        "due_at": F.col("ts") + F.make_dt_interval(secs=delay),
        "reason": reason,
    })


def queue_state(
    deliveries: DataFrame, now: Column, ttl_hours: int = C.MESSAGE_TTL_HOURS,
    max_length: int = C.QUEUE_MAX_LENGTH, seq: str = "seq", block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """``state`` live, expired (too old) or overflow (beyond the newest ``max_length``).

    Positions come from per-block counts, so one crowded queue is spread over tasks.
    """
    ranked = blocks.running_count(
        deliveries, ["queue"], [F.col(seq).desc()], blocks.by_sequence(seq, block_rows), "age_rank",
        descending=True)
    too_old = F.col("ts") < now - F.make_dt_interval(hours=F.lit(ttl_hours))
    return ranked.withColumn(
        "state",
        F.when(too_old, F.lit("expired")).when(F.col("age_rank") > max_length, F.lit("overflow"))
        .otherwise(F.lit("live")))


def chain_records(events: DataFrame) -> DataFrame:
    """Known events, one record per (student, event)."""
    known = events.filter(F.col("event_type").isin(C.EVENT_TYPES))
    return keep_first(known.select("student_id", "event_id", "event_type", "seq"),
                      ["student_id", "event_id"], "seq")


def event_chain(records: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Consumption order: position of every record in its student's chain, starting at 0."""
    ranked = blocks.running_count(
        records, ["student_id"], [F.col("seq")], blocks.by_sequence("seq", block_rows), "position")
    return ranked.withColumn("position", F.col("position") - 1)


def _first_of(event_type: str) -> Column:
    return F.min(F.when(F.col("event_type") == event_type, F.col("seq")))


def first_steps(records: DataFrame) -> DataFrame:
    """First arrival of each event type per student: all that the order rules need."""
    return records.groupBy("student_id").agg(
        F.min("seq").alias("first_any"),
        _first_of(C.CHECKIN_SUCCESS).alias("first_checkin"),
        _first_of(C.PAYMENT_COMPLETED).alias("first_payment"),
        _first_of(C.VERIFIED_SUCCESS).alias("first_verified"),
        _first_of(C.CHECKIN_COMPLETED).alias("first_completed"),
    )


def chain_ordered(records: DataFrame) -> DataFrame:
    """Whether check-in opens the chain and completion follows payment and verification."""
    def not_before(other: str) -> Column:
        return F.col("first_completed").isNull() | F.col(other).isNull() | (
            F.col("first_completed") > F.col(other))

    opens = F.coalesce(F.col("first_checkin") == F.col("first_any"), F.lit(False))
    ordered = opens & not_before("first_payment") & not_before("first_verified")
    return first_steps(records).select("student_id", ordered.alias("ordered"))


def completion_check(records: DataFrame) -> DataFrame:
    """Completion events with ``prerequisites_met``: all three steps were consumed before."""
    completed = records.filter(F.col("event_type") == C.CHECKIN_COMPLETED)
    steps = first_steps(records).select("student_id", "first_checkin", "first_payment", "first_verified")
    met = F.lit(True)
    for step in ("first_checkin", "first_payment", "first_verified"):
        met = met & F.coalesce(F.col(step) < F.col("seq"), F.lit(False))
    return completed.join(steps, "student_id", "left").withColumn("prerequisites_met", met).drop(
        "first_checkin", "first_payment", "first_verified")


def notify_parents(events: DataFrame, registrations: DataFrame) -> DataFrame:
    """A message per check-in whose student has a registered phone; the others stay unpushed."""
    phones = registrations.filter("registered").groupBy("student_id").agg(F.min("phone").alias("phone"))
    checkins = events.filter(F.col("event_type") == C.CHECKIN_SUCCESS)
    joined = lookup(checkins, phones, "student_id", ["event_id"])
    return joined.withColumns({
        "pushed": F.col("phone").isNotNull(),
        "content": F.when(F.col("phone").isNotNull(), F.lit(C.NOTIFICATION_TEXT)),
    })
