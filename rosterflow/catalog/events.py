"""Domain-event and progress queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.catalog import views as V
from rosterflow.functions.times import instant_text
from rosterflow.operators import events as ops
from rosterflow.operators import progress
from rosterflow.sources import envelopes as src


def events_view(spark, sf):
    return V.view(spark, sf, V.EVENTS)


def _json_events(spark, sf):
    payload = F.struct(
        F.when(F.col("value") >= 5, F.col("student_id")).alias("studentId"),
        F.col("value").cast("decimal(12,2)").alias("payAmount"))
    body = F.to_json(F.struct(
        F.col("event_id").alias("eventId"), F.col("event_type").alias("eventType"),
        instant_text(F.col("ts")).alias("eventTime"),
        F.lit("checkin-service").alias("source"), F.concat(F.lit("t-"), F.col("seq").cast("string")).alias("traceId"),
        F.when(F.col("retry_count") == 4, F.lit("2.0")).alias("version"), payload.alias("payload"),
        F.when(F.col("retry_count") > 0, F.col("retry_count")).alias("retryCount")))
    return events_view(spark, sf).select("seq", body.alias("value"))


def event_parse(spark, sf):
    parsed = src.parse_envelopes(_json_events(spark, sf))
    paid = src.payload_of(C.PAYMENT_COMPLETED)["payAmount"]
    amount = F.when(F.col("event_type") == C.PAYMENT_COMPLETED, (paid * 100).cast("bigint"))
    return parsed.select(
        "seq", "event_id", "event_type", instant_text(F.col("event_time")).alias("event_time"),
        "source", "trace_id", "version", "retry_count", "student_id", "known_type", amount.alias("pay_cents"))


def _enveloped(events, *more):
    return events.select(
        "event_id", "event_type", F.col("ts").alias("event_time"), F.lit("checkin-service").alias("source"),
        F.lit("t").alias("trace_id"), F.lit("1.0").alias("version"),
        F.to_json(F.struct(F.col("student_id").alias("studentId"))).alias("payload"), "retry_count", *more)


def _shown(rows, *columns):
    headers = F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), F.decode(h["value"], "utf-8")))
    return rows.select(*columns, "key", "value", F.array_join(headers, ";").alias("headers"))


def event_publish_json(spark, sf):
    return _shown(src.publish_rows(_enveloped(events_view(spark, sf))))


def event_retry_publish(spark, sf):
    return _shown(src.retry_rows(_enveloped(_consumed(spark, sf), "queue", "action", "reason")), "exchange")


def event_dedupe(spark, sf):
    return ops.dedupe(events_view(spark, sf).select("event_id", "seq", "event_type", "student_id"), ["event_id"])


def event_dedupe_horizon(spark, sf):
    """One event a student and type passes within a horizon."""
    keyed = events_view(spark, sf).select("seq", "ts", "event_type", "student_id", F.concat(
        "event_type", F.lit(":"), "student_id").alias("key"))
    return ops.dedupe_horizon(keyed, "key").select("seq", "event_type", "student_id")


def event_fanout(spark, sf):
    return ops.fan_out(events_view(spark, sf)).select("seq", "event_id", "event_type", "queue")


def _consumed(spark, sf):
    return ops.consume(ops.fan_out(events_view(spark, sf)))


def retry_plan(spark, sf):
    return _consumed(spark, sf).select(
        "seq", "queue", "action", "next_retry", "retry_key", "delay_seconds", "due_at")


def event_dead_letter(spark, sf):
    return _consumed(spark, sf).filter("action = 'DEAD_LETTER'").select("seq", "queue", "event_id", "reason")


def queue_expiry(spark, sf):
    view = events_view(spark, sf)
    now = view.agg(F.max("ts").alias("now")).select("now").scalar()
    return ops.queue_state(ops.fan_out(view), now, ttl_hours=48, max_length=60).select("seq", "queue", "state")


def event_chain(spark, sf):
    return ops.event_chain(ops.chain_records(events_view(spark, sf))).select(
        "student_id", "position", "event_type")


def chain_ordered(spark, sf):
    return ops.chain_ordered(ops.chain_records(events_view(spark, sf)))


def completion_prereq(spark, sf):
    return ops.completion_check(ops.chain_records(events_view(spark, sf))).select(
        "seq", "student_id", "prerequisites_met")


def parent_notify(spark, sf):
    return ops.notify_parents(events_view(spark, sf), V.view(spark, sf, V.REGISTRATIONS)).select(
        "seq", "student_id", "phone", "pushed", "content")


def _steps(spark, sf):
    students = V.table(spark, sf, "customer").select(
        (F.col("c_acctbal") >= 0).alias("registered"), F.col("c_custkey").cast("string").alias("student_id"), F.col("c_name").alias("student_name"),
        F.col("c_mktsegment").alias("college"),
        F.array(F.lit("photo"), F.lower("c_mktsegment")).alias("materials"))
    return progress.student_steps(students, events_view(spark, sf))


def student_steps(spark, sf):
    return _steps(spark, sf).select("student_id", "step_code", "step_name", "completed", "completed_at")


def student_progress(spark, sf):
    listed = F.transform("steps", lambda s: F.concat(
        s["step_code"], F.lit("="), F.coalesce(s["completed_at"], F.lit("-"))))
    return progress.student_progress(_steps(spark, sf)).select(
        "student_id", "student_name_masked", "completed_steps", "total_steps", "progress_percent",
        "arrival_status", "arrival_display", F.array_join(listed, ",").alias("steps"),
        F.array_join("pending_materials", ",").alias("pending_materials"))


def rate_by_group(spark, sf):
    return progress.rate_by_group(_steps(spark, sf), "college")


def step_funnel(spark, sf):
    return progress.step_funnel(_steps(spark, sf))


def hourly_arrivals(spark, sf):
    return progress.hourly_arrivals(events_view(spark, sf))


QUERIES = {fn.__name__: fn for fn in (
    event_parse, event_publish_json, event_retry_publish, event_dedupe, event_dedupe_horizon, event_fanout, retry_plan, event_dead_letter, queue_expiry,
    event_chain, chain_ordered, completion_prereq, parent_notify, student_steps, student_progress, rate_by_group,
    step_funnel, hourly_arrivals)}

_KNOWN = "'student.checkin.success', 'student.payment.completed', 'student.verified.success', 'student.checkin.completed'"
_BINDINGS = "select * from (values " + ", ".join(f"('{t}', '{q}')" for t, q in C.BINDINGS) + ") b(event_type, queue)"
_DELIVERED = "select e.*, b.queue from v_events e join bindings b on b.event_type = e.event_type"
_CONSUMED = """
select *, case when copy_no > 1 then 'DUPLICATE' when handler_result = 'OK' then 'OK'
    when handler_result = 'NON_RETRYABLE' then 'DEAD_LETTER' when retry_count >= 3 then 'DEAD_LETTER' else 'RETRY' end as action
from (select *, row_number() over (partition by queue, event_id, retry_count order by seq) as copy_no from delivered) d
"""
_RECORDS = f"""
select * from (select *, row_number() over (partition by student_id, event_id order by seq) as copy_no
  from v_events where event_type in ({_KNOWN})) r where copy_no = 1
"""
_STEPS = """
select c.c_custkey, c.c_name, c.c_mktsegment, s.step_no, s.step_code, s.step_name,
  (select max_by(e.ts, e.seq) from v_events e where e.event_type = s.event_type and e.student_id = cast(c.c_custkey as string)) as completed_at
from customer c, (values """ + ", ".join(
    f"({i}, '{c}', '{n}', '{t}')" for i, (c, n, t) in enumerate(C.PROGRESS_STEPS)) + """) s(step_no, step_code, step_name, event_type)
where c.c_acctbal >= 0
"""


def _body_sql(count):
    return f"""'{{"eventId":"' || event_id || '","eventType":"' || event_type || '","eventTime":"' || {V.instant('ts')}
      || '","source":"checkin-service","traceId":"t","version":"1.0","payload":{{"studentId":"' || student_id
      || '"}},"retryCount":' || cast({count} as string) || '}}'"""


_D = dict(v_events=V.EVENTS, bindings=_BINDINGS, delivered=_DELIVERED)
_CD = dict(**_D, consumed=_CONSUMED)
_R = dict(v_events=V.EVENTS, records=_RECORDS)
_S = dict(v_events=V.EVENTS, steps=_STEPS)

ORACLES = {
    "event_parse": V.oracle(f"""
      select seq, event_id, event_type, {V.instant('ts')} as event_time, 'checkin-service' as source,
        't-' || cast(seq as string) as trace_id, case when retry_count = 4 then '2.0' else '1.0' end as version,
        cast(retry_count as int) as retry_count, case when value >= 5 then student_id else 'unknown' end as student_id,
        event_type in ({_KNOWN}) as known_type,
        case when event_type = 'student.payment.completed' then cast(round(value * 100) as bigint) end as pay_cents
      from v_events""", v_events=V.EVENTS),
    "event_publish_json": V.oracle(f"""
      select event_type as key, {_body_sql('retry_count')} as value,
        'message-id=' || event_id || ';x-retry-count=' || cast(retry_count as string) as headers
      from v_events""", v_events=V.EVENTS),
    "event_retry_publish": V.oracle(f"""
      , failed as (select *, case when action = 'RETRY' then retry_count + 1 else retry_count end as next,
          case when handler_result = 'NON_RETRYABLE' then 'NonRetryableException: NON_RETRYABLE'
            else 'MaxRetryExceeded: retryCount=' || cast(retry_count as string) || ', lastError=RETRYABLE' end as reason
        from consumed where action in ('RETRY', 'DEAD_LETTER'))
      select case action when 'RETRY' then '{C.RETRY_EXCHANGE}' else '{C.DEAD_LETTER_EXCHANGE}' end as exchange,
        case action when 'RETRY' then 'retry.' || cast(next as string) else event_type end as key, {_body_sql('next')} as value,
        case action when 'RETRY' then 'x-retry-count=' || cast(next as string) || ';x-original-queue=' || queue
            || ';x-original-routing-key=' || event_type
          else 'x-dead-letter-reason=' || reason || ';x-retry-count=' || cast(next as string) end as headers
      from failed""", **_CD),
    "event_dedupe": V.oracle("""
      select event_id, seq, event_type, student_id from (
        select *, row_number() over (partition by event_id order by seq) as rn from v_events) t where rn = 1""",
        v_events=V.EVENTS),
    "event_dedupe_horizon": V.oracle("recursive:" + """
      select seq, event_type, student_id from passed where seq = passing""",
        v_events=V.EVENTS, placed="""
      select seq, event_type, student_id, epoch_us(ts) // 1000 as ms, event_type || ':' || student_id as key,
        row_number() over (partition by event_type, student_id order by epoch_us(ts) // 1000, seq) as i from v_events""",
        passed=f"""
      select seq, event_type, student_id, key, i, ms as since, seq as passing from placed where i = 1
      union all
      select n.seq, n.event_type, n.student_id, n.key, n.i,
        case when n.ms - p.since > {C.IDEMPOTENT_HOURS * 3_600_000} then n.ms else p.since end,
        case when n.ms - p.since > {C.IDEMPOTENT_HOURS * 3_600_000} then n.seq else p.passing end
      from passed p join placed n on n.key = p.key and n.i = p.i + 1"""),
    "event_fanout": V.oracle("select seq, event_id, event_type, queue from delivered", **_D),
    "retry_plan": V.oracle("""
      select seq, queue, action, case when action = 'RETRY' then cast(retry_count + 1 as int) end as next_retry,
        case when action = 'RETRY' then 'retry.' || cast(retry_count + 1 as string) end as retry_key,
        case when action = 'RETRY' then case retry_count when 0 then 10 when 1 then 30 else 60 end end as delay_seconds,
        case when action = 'RETRY' then ts + case retry_count when 0 then interval 10 second when 1 then interval 30 second
          else interval 60 second end end as due_at from consumed""", **_CD),
    "event_dead_letter": V.oracle("""
      select seq, queue, event_id, case when handler_result = 'NON_RETRYABLE' then 'NonRetryableException: NON_RETRYABLE'
        else 'MaxRetryExceeded: retryCount=' || cast(retry_count as string) || ', lastError=RETRYABLE' end as reason
      from consumed where action = 'DEAD_LETTER'""", **_CD),
    "queue_expiry": V.oracle("""
      select seq, queue, case when ts < (select max(ts) from v_events) - interval 48 hour then 'expired'
        when row_number() over (partition by queue order by seq desc) > 60 then 'overflow' else 'live' end as state
      from delivered""", **_D),
    "event_chain": V.oracle("""
      select student_id, row_number() over (partition by student_id order by seq) - 1 as position, event_type from records""", **_R),
    "chain_ordered": V.oracle("""
      , firsts as (
          select student_id, arg_min(event_type, seq) as opening,
            min(seq) filter (event_type = 'student.payment.completed') as paid,
            min(seq) filter (event_type = 'student.verified.success') as verified,
            min(seq) filter (event_type = 'student.checkin.completed') as done
          from records group by student_id)
      select student_id, opening = 'student.checkin.success'
        and coalesce(done > greatest(paid, verified), true) as ordered from firsts""", **_R),
    "completion_prereq": V.oracle("""
      select seq, student_id, c and p and v as prerequisites_met from (select *,
        coalesce(bool_or(event_type = 'student.checkin.success') over w, false) as c,
        coalesce(bool_or(event_type = 'student.payment.completed') over w, false) as p,
        coalesce(bool_or(event_type = 'student.verified.success') over w, false) as v from records
        window w as (partition by student_id order by seq rows between unbounded preceding and 1 preceding)) t
      where event_type = 'student.checkin.completed'""", **_R),
    "parent_notify": V.oracle(f"""
      , phones as (select student_id, min(phone) as phone from registrations where registered group by 1)
      select seq, e.student_id, p.phone, p.phone is not null as pushed,
        case when p.phone is not null then '{C.NOTIFICATION_TEXT}' end as content
      from v_events e left join phones p on p.student_id = e.student_id
      where event_type = 'student.checkin.success'""", v_events=V.EVENTS, registrations=V.REGISTRATIONS),
    "student_steps": V.oracle("""
      select cast(c_custkey as string) as student_id, step_code, step_name, completed_at is not null as completed,
        completed_at from steps""", **_S),
    "student_progress": V.oracle("""
      , agg as (select c_custkey, max(c_name) as n, max(c_mktsegment) as seg, count(completed_at) as done,
          max(case when step_no = 0 and completed_at is not null then 1 else 0 end) as arrived,
          string_agg(step_code || '=' || coalesce(strftime(completed_at, '%Y-%m-%d'), '-'), ',' order by step_no) as steps
        from steps group by c_custkey),
       labelled as (select *, case when done = 4 then 'completed' when arrived = 1 then 'arrived' else 'not_arrived' end as st from agg)
      select cast(c_custkey as string) as student_id, substr(n, 1, 1) || repeat('*', length(n) - 2) || substr(n, length(n), 1) as student_name_masked,
        done as completed_steps, cast(4 as bigint) as total_steps, done * 100 // 4 as progress_percent, st as arrival_status,
        case st when 'completed' then '报到完成' when 'arrived' then '已到校' else '未到校' end as arrival_display,
        steps, 'photo,' || lower(seg) as pending_materials from labelled""", **_S),
    "rate_by_group": V.oracle("""
      select c_mktsegment as college, count(*) as registered, count(completed_at) as completed,
        count(completed_at) * 100 // count(*) as percent from steps where step_no = 3 group by 1""", **_S),
    "step_funnel": V.oracle("""
      , opened as (select *, min(case when completed_at is null then step_no end) over (partition by c_custkey) as first_open from steps)
      select step_code, count(*) filter (completed_at is not null) as done,
        count(*) filter (completed_at is null and step_no = first_open) as in_progress,
        count(*) filter (completed_at is null and step_no <> first_open) as to_do from opened group by 1""", **_S),
    "hourly_arrivals": V.oracle("""
      select date_trunc('hour', ts) as hour, count(*) as arrivals from v_events
      where event_type = 'student.checkin.success' group by 1""", v_events=V.EVENTS),
}
