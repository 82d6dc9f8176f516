"""Continuous event consumption: dedupe, retries that come back when due, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.operators import events as ops
from rosterflow.operators import progress
from rosterflow.session import written
from rosterflow.streaming.batches import merged_handler, read_state

HandlerResult = Callable[[DataFrame], DataFrame]

STEP_SCHEMA = "student_id string, step_code string, completed_at timestamp_ntz, seq bigint"


def dedupe_stream(events: DataFrame, keys: list[str], ts: str = "event_time") -> DataFrame:
    """First copy per key; ids are remembered for the idempotence horizon."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, f"{C.IDEMPOTENT_HOURS} hours").dropDuplicatesWithinWatermark(keys)


def consume_handler(handler: HandlerResult, root: str, horizon_hours: int = C.IDEMPOTENT_HOURS):
    """Handler for :func:`run_batches`: consumed rows, dead letters and the retries still waiting.

    ``handler`` adds ``handler_result`` to deliveries; it never sees a copy, be the first delivery in this batch or in an
    earlier one less than ``horizon_hours`` of event time ago.  Copies are kept as rows with the action DUPLICATE.
    A retry waits in the ``waiting`` table until the newest event time reaches its due time.
    """
    seen_schema = "queue string, event_id string, retry_count int, ts timestamp_ntz"

    def handle(batch: DataFrame, batch_id: int) -> Iterator[tuple]:
        spark = batch.sparkSession
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields)
        waiting = read_state(spark, root, "waiting", fields + ", due_at timestamp_ntz", batch_id)
        seen = read_state(spark, root, "seen", seen_schema, batch_id)
        now = batch.select("ts").union(seen.select("ts")).agg(F.max("ts").alias("now")).select("now").scalar()
        is_due = F.coalesce(F.col("due_at") <= now, F.lit(False))
        due = waiting.filter(is_due).withColumn("ts", F.col("due_at")).drop("due_at")
        known = seen.groupBy(*ops.DELIVERY).agg(F.lit(True).alias("known"))
        marked = ops.mark_copies(batch.unionByName(due)).join(known, ops.DELIVERY, "left").withColumn(
            "copy", F.col("copy") | F.coalesce("known", F.lit(False))).drop("known").persist()
        results = handler(marked.filter("not copy").drop("copy")).withColumn("copy", F.lit(False))
        consumed = ops.planned(results.unionByName(marked.filter("copy"), allowMissingColumns=True)).persist()
        again = consumed.filter("action = 'RETRY'").withColumn("retry_count", F.col("next_retry")).select(
            *batch.columns, "due_at")
        met = marked.filter("not copy").select(*ops.DELIVERY, F.col("ts"))
        try:
            yield "consumed", consumed.select("seq", "queue", "event_id", "retry_count", "action")
            yield "dead_letters", consumed.filter("action = 'DEAD_LETTER'").select("seq", "queue", "event_id", "reason")
            yield "waiting", again.unionByName(waiting.filter(~is_due))
            yield "seen", seen.unionByName(met).filter(F.col("ts") > now - F.make_dt_interval(hours=F.lit(horizon_hours)))
        finally:
            consumed.unpersist()
            marked.unpersist()

    return handle


def expiry_handler(root: str, ttl_hours: int = C.MESSAGE_TTL_HOURS, max_length: int = C.QUEUE_MAX_LENGTH):
    """Handler for :func:`run_batches`: the queues as they stand after a batch, and the messages it made them drop.

    ``live`` is the state: the live messages of all batches so far, so neither age nor length depends on how the stream
    was cut.  ``dropped`` adds up over the batches.
    """
    def handle(batch: DataFrame, batch_id: int) -> Iterator[tuple]:
        spark = batch.sparkSession
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields)
        live = read_state(spark, root, "live", fields, batch_id)
        clock = read_state(spark, root, "clock", "now timestamp_ntz", batch_id)
        newest = clock.union(batch.select("ts")).agg(F.max("now").alias("now"))
        judged = ops.queue_state(batch.unionByName(live), newest.select("now").scalar(), ttl_hours, max_length).persist()
        try:
            yield "clock", newest
            yield "live", judged.filter("state = 'live'").select(*batch.columns)
            yield "dropped", judged.filter("state <> 'live'")
        finally:
            judged.unpersist()

    return handle


def progress_handler(batch: DataFrame, batch_id: int) -> Iterator[tuple]:
    """Handler for :func:`run_batches`: the latest completion per (student, step) of one batch."""
    yield "steps", progress.latest_steps(batch, with_seq=True)


def merged_steps(rows: DataFrame) -> DataFrame:
    """The latest completion per (student, step) of several runs."""
    return rows.groupBy("student_id", "step_code").agg(
        F.max_by("completed_at", "seq").alias("completed_at"), F.max("seq").alias("seq"))


def merged_progress_handler(root: str):
    """:func:`progress_handler` whose table is merged as it grows, so that reading it touches few folders."""
    return merged_handler(root, "steps", STEP_SCHEMA, lambda batch: progress.latest_steps(batch, with_seq=True), merged_steps)


def current_steps(deltas: DataFrame) -> DataFrame:
    """State over all batches: the delta with the latest arrival wins."""
    return deltas.groupBy("student_id", "step_code").agg(
        F.max_by("completed_at", "seq").alias("completed_at"))


HOURS_SCHEMA = "hour timestamp_ntz, arrivals bigint"


def arrivals_handler(root: str, lateness: str = "2 hours"):
    """Handler for :func:`run_batches`: check-ins per hour in event time.

    The watermark of a batch lies ``lateness`` behind the latest time of the batches before it.  ``hours`` gets an hour once
    the watermark has passed its end; ``open_hours`` is the state of all others.  Check-ins of an hour that has been given
    out are kept in ``late``, with their hour, instead of being lost.  Rows without a time are late.
    """
    def handle(batch: DataFrame, batch_id: int) -> Iterator[tuple]:
        spark = batch.sparkSession
        held = read_state(spark, root, "open_hours", HOURS_SCHEMA, batch_id)
        before = read_state(spark, root, "watermark", "latest timestamp_ntz", batch_id)
        after = written(before.union(batch.select(F.col("ts").cast("timestamp_ntz"))).agg(F.max("latest").alias("latest")), "watermark")
        closed = [t.select((F.col("latest") - F.expr(f"interval {lateness}")).alias("w")).select("w").scalar() for t in (before, after)]
        rows = batch.filter(F.col("event_type") == C.CHECKIN_SUCCESS).withColumn(
            "hour", F.window(F.col("ts").cast("timestamp"), "1 hour")["start"].cast("timestamp_ntz"))
        end = F.col("hour") + F.expr("interval 1 hour")
        late = F.coalesce(end <= closed[0], F.col("hour").isNull())
        rows = rows.withColumn("late", F.coalesce(late, F.lit(False)))
        counted = held.unionByName(rows.filter(~F.col("late")).groupBy("hour").agg(F.count(F.lit(1)).alias("arrivals")))
        counted = written(counted.groupBy("hour").agg(F.sum("arrivals").alias("arrivals")).withColumn(
            "done", F.coalesce(end <= closed[1], F.lit(False))), "hours")
        yield "hours", counted.filter("done").drop("done")
        yield "open_hours", counted.filter("not done").drop("done")
        yield "late", rows.filter("late").select("seq", "ts", "hour")
        yield "watermark", after

    return handle
