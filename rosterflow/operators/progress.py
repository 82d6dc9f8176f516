"""Progress roll-ups and dashboard counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.functions.privacy import mask_name
from rosterflow.operators.joins import fixed_table


def latest_steps(events: DataFrame, with_seq: bool = False) -> DataFrame:
    """Last completion time per (student, step) by arrival."""
    steps = fixed_table(
        events.sparkSession, C.PROGRESS_STEPS, "step_code string, step_name string, event_type string")
    latest = [F.max_by("ts", "seq").alias("completed_at")] + ([F.max("seq").alias("seq")] if with_seq else [])
    return events.join(steps, "event_type").groupBy("student_id", "step_code").agg(*latest)


def student_steps(students: DataFrame, events: DataFrame) -> DataFrame:
    """Every step of every student with ``registered``; steps never seen are open."""
    registered = students.filter("registered").drop("registered")
    steps = F.array(*[
        F.struct(F.lit(i).alias("step_no"), F.lit(code).alias("step_code"), F.lit(name).alias("step_name"))
        for i, (code, name, _) in enumerate(C.PROGRESS_STEPS)])
    expected = registered.withColumn("__s", F.explode(steps)).select(*registered.columns, "__s.*")
    done = latest_steps(events)
    return expected.join(done, ["student_id", "step_code"], "left").withColumn(
        "completed", F.col("completed_at").isNotNull())


def date_only(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def student_progress(steps: DataFrame) -> DataFrame:
    """One row per student: counts, percent, arrival status, step list and open materials."""
    done = F.col("completed")
    grouped = steps.groupBy("student_id").agg(
        F.first("student_name").alias("student_name"),
        F.first("materials").alias("pending_materials"),
        F.count_if(done).alias("completed_steps"),
        F.count(F.lit(1)).alias("total_steps"),
        F.bool_or(done & (F.col("step_code") == C.PROGRESS_STEPS[0][0])).alias("__arrived"),
        F.array_sort(F.collect_list(F.struct(
            "step_no", "step_code", "step_name", "completed",
            date_only(F.col("completed_at")).alias("completed_at")))).alias("steps"),
    )
    status = (
        F.when(F.col("completed_steps") == F.col("total_steps"), F.lit("completed"))
        .when(F.col("__arrived"), F.lit("arrived")).otherwise(F.lit("not_arrived")))
    display = F.create_map(*[F.lit(x) for pair in C.ARRIVAL_DISPLAY.items() for x in pair])
    return (
        grouped.withColumn("arrival_status", status)
        .withColumn("arrival_display", F.element_at(display, F.col("arrival_status")))
        .withColumn("student_name_masked", F.coalesce(mask_name(F.col("student_name")), F.lit("")))
        .withColumn("progress_percent", F.expr("(completed_steps * 100) div total_steps"))
        .drop("__arrived", "student_name")
    )


def rate_by_group(steps: DataFrame, group: str) -> DataFrame:
    """Completed students per group as counts and percent of the registered ones."""
    last = steps.filter(F.col("step_code") == C.PROGRESS_STEPS[-1][0])
    return last.groupBy(group).agg(
        F.count(F.lit(1)).alias("registered"), F.count_if("completed").alias("completed"),
    ).withColumn("percent", F.expr("(completed * 100) div registered"))


def step_funnel(steps: DataFrame) -> DataFrame:
    """Done, in progress and to do per step; a step is in progress when all steps before it are done."""
    open_before = F.array(*[
        F.struct(F.lit(i).alias("step_no"), F.lit(code).alias("step_code"))
        for i, (code, _, _) in enumerate(C.PROGRESS_STEPS)])
    wide = steps.groupBy("student_id").agg(
        F.min(F.when(~F.col("completed"), F.col("step_no"))).alias("first_open"),
        F.collect_set(F.when(F.col("completed"), F.col("step_no"))).alias("done_nos"))
    each = wide.withColumn("__s", F.explode(open_before)).select("__s.*", "first_open", "done_nos")
    done = F.array_contains("done_nos", F.col("step_no"))
    current = ~done & (F.col("step_no") == F.col("first_open"))
    return each.groupBy("step_code").agg(
        F.count_if(done).alias("done"), F.count_if(current).alias("in_progress"),
        F.count_if(~done & ~current).alias("to_do"))


def hourly_arrivals(events: DataFrame) -> DataFrame:
    """Check-ins per hour."""
    return events.filter(F.col("event_type") == C.CHECKIN_SUCCESS).groupBy(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("arrivals"))
