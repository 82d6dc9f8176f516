"""Limit, access and tool-call queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.catalog import views as V
from rosterflow.operators import access, limits
from rosterflow.session import shared_dir
from rosterflow.sources import audit

# The given events have few requests per user and hour, so the limits run with long windows.
BUCKET, REFILL_PER_MINUTE = 2, 1 / 720
WINDOW_SECONDS, WINDOW_MAX = 86_400, 2
LOG_SECONDS, LOG_MAX = 36_000, 1
MAX_ERRORS, LOCK_SECONDS = 4, 43_200
BLOCK_MS = 5 * 86_400_000


def _log(spark, sf):
    return V.view(spark, sf, V.ACCESS)


def _requests(spark, sf):
    return V.view(spark, sf, V.ATTEMPTS)


def access_log_route(spark, sf):
    return access.route(_log(spark, sf)).select("seq", "rule", "rate_key", "retry_after")


def revoked_access(spark, sf):
    return access.mark_revoked(_log(spark, sf), V.view(spark, sf, V.REVOCATIONS)).select("seq", "jti", "revoked")


def revoke_by_phone(spark, sf):
    return access.revoke_by_phone(V.view(spark, sf, V.REVOCATIONS))


def rate_token_bucket(spark, sf):
    return limits.token_bucket(_requests(spark, sf), "phone", BUCKET, REFILL_PER_MINUTE, block_ms=BLOCK_MS).select(
        "seq", "allowed", F.round("tokens_left", 6).alias("tokens_left"))


def rate_anchored_window(spark, sf):
    return limits.anchored_window(
        _requests(spark, sf), "phone", WINDOW_MAX, WINDOW_SECONDS, block_ms=BLOCK_MS).select(
        "seq", "allowed", "remaining", "reset_epoch", "retry_after")


def rate_sliding_log(spark, sf):
    return limits.sliding_log(
        _requests(spark, sf), "phone", LOG_MAX, LOG_SECONDS, block_ms=BLOCK_MS).select("seq", "allowed")


def lockout(spark, sf):
    return limits.lockout(
        _requests(spark, sf), "phone", MAX_ERRORS, LOCK_SECONDS, block_ms=BLOCK_MS).select(
        "seq", "outcome", "errors", "lock_minutes")


def burst_count(spark, sf):
    return limits.burst_count(_requests(spark, sf), "phone", WINDOW_SECONDS, 3).select("seq", "recent", "limited")


def _calls(spark, sf):
    params = F.create_map(
        F.lit("student_id"), F.col("p_student_id"), F.lit("step_id"), F.col("p_step_id"),
        F.lit("poi_id"), F.col("p_poi_id"))
    return V.view(spark, sf, V.TOOL_CALLS).withColumn("params", params)


def _outcomes(spark, sf):
    return access.tool_outcomes(_calls(spark, sf), 2, WINDOW_SECONDS)


def tool_call_outcome(spark, sf):
    return _outcomes(spark, sf).select("seq", "tool_name", "success", "error_code", "shown_name", "url")


def poi_lookup(spark, sf):
    return access.poi_lookup(_calls(spark, sf), "p_poi_id").select(
        "seq", F.col("p_poi_id").alias("poi_id"), "poi_name", "distance", "nav_url", "poi_error")


def tool_error_counts(spark, sf):
    return _outcomes(spark, sf).groupBy("tool_name", "error_code").agg(F.count(F.lit(1)).alias("calls"))


def audit_by_student(spark, sf):
    """Calls and failures by student, from a log that the outcomes were appended to."""
    path = shared_dir(spark, "tool-calls")
    audit.append_calls(_outcomes(spark, sf), path)
    logged = audit.all_calls(spark, path)
    return logged.groupBy("student_id", F.col("params")["student_id"].alias("masked_student_id")).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~F.col("success")).alias("failures"), F.max("ts").alias("last_call"))


def bind_request_outcome(spark, sf):
    return access.bind_outcomes(
        V.view(spark, sf, V.BIND_REQUESTS), V.view(spark, sf, V.REGISTRATIONS), LOG_SECONDS, LOG_MAX,
        MAX_ERRORS, LOCK_SECONDS).select("seq", "phone", "code")


def egress_audit(spark, sf):
    return access.egress_audit(V.view(spark, sf, V.CONNECTIONS), V.view(spark, sf, V.ALLOW_LIST))


def egress_violations(spark, sf):
    return egress_audit(spark, sf).agg(
        F.count_if(F.col("verdict") == "FAIL").alias("violations"), F.count(F.lit(1)).alias("targets"))


QUERIES = {fn.__name__: fn for fn in (
    access_log_route, revoked_access, revoke_by_phone, rate_token_bucket, rate_anchored_window, rate_sliding_log, lockout,
    burst_count, tool_call_outcome, poi_lookup, tool_error_counts, audit_by_student, bind_request_outcome, egress_audit,
    egress_violations)}

_R = "recursive:"
_NUMBERED = """
select *, epoch_us(ts) // 1000 as ms, row_number() over (partition by phone order by ts, seq) as i from v_requests
"""
_BUCKET = f"""
select seq, phone, i, ms, {float(BUCKET)}::double - 1 as tokens, true as allowed from numbered where i = 1
union all
select n.seq, n.phone, n.i, n.ms, case when r.have >= 1 then r.have - 1 else r.have end, r.have >= 1
from (select b.phone, b.i, m.ms as next_ms, least({float(BUCKET)}::double, b.tokens + ((m.ms - b.ms) / 1000.0::double) * ((1::double / 720) / 60.0::double)) as have
      from bucket b join numbered m on m.phone = b.phone and m.i = b.i + 1) r
join numbered n on n.phone = r.phone and n.i = r.i + 1
"""
_W = WINDOW_SECONDS * 1000


def _window_sql(source):
    return f"""
select seq, student, i, ms, ms as start_ms, 1 as used from {source} where i = 1
union all
select n.seq, n.student, n.i, n.ms, case when n.ms - w.start_ms > {_W} then n.ms else w.start_ms end,
  case when n.ms - w.start_ms > {_W} then 1 else w.used + 1 end
from opened w join {source} n on n.student = w.student and n.i = w.i + 1
"""


def _log_sql(source):
    return f"""
select seq, phone, i, ms, true as allowed, ms as last_ms from {source} where i = 1
union all
select n.seq, n.phone, n.i, n.ms, l.last_ms <= n.ms - {LOG_SECONDS * 1000},
  case when l.last_ms <= n.ms - {LOG_SECONDS * 1000} then n.ms else l.last_ms end
from logged l join {source} n on n.phone = l.phone and n.i = l.i + 1
"""


def _lock_sql(source):
    lock = LOCK_SECONDS * 1000
    return f"""
select seq, phone, i, result as outcome, case when result = 'ok' then 0 else 1 end as errors, cast(null as bigint) as until_ms, 0 as lock_minutes
from {source} where i = 1
union all
select seq, phone, i, case when locked then 'locked' else result end,
  case when locked then errors when result = 'ok' then 0 else errors + 1 end,
  case when locked then until_ms when result <> 'ok' and errors + 1 >= {MAX_ERRORS} then ms + {lock} end,
  case when locked then (until_ms // 1000 - ms // 1000) // 60 + 1 else 0 end
from (select n.seq, n.phone, n.i, n.ms, n.result, l.until_ms is not null and n.ms <= l.until_ms as locked,
        case when l.until_ms is not null and n.ms > l.until_ms then 0 else l.errors end as errors, l.until_ms
      from locks l join {source} n on n.phone = l.phone and n.i = l.i + 1) s
"""


_STEPS = "select * from (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in C.STEP_CATALOGUE) + ") s(step_id, step_name, page_url)"
_POIS = "select * from (values " + ", ".join(f"('{a}', '{b}', {d})" for a, b, _, d in C.POI_CATALOGUE) + ") p(poi_id, poi_name, distance)"
_KNOWN_CALLS = """
select seq, student_id as student, epoch_us(ts) // 1000 as ms, row_number() over (partition by student_id order by ts, seq) as i
from v_calls where tool_name <> 'unknown_tool'
"""
_CALLED = """
select c.*, s.step_name, s.page_url, p.poi_name, case when c.tool_name = 'unknown_tool' then 'TOOL_NOT_FOUND' when o.used > 2 then 'RATE_LIMITED'
  when c.tool_name = 'navigate_to_step' then case when trim(coalesce(c.p_student_id, '')) = '' or trim(coalesce(c.p_step_id, '')) = ''
    or s.step_id is null then 'INVALID_PARAM' end
  else case when trim(coalesce(c.p_poi_id, '')) = '' then 'INVALID_PARAM' when p.poi_id is null then 'NOT_FOUND' end end as error_code
from v_calls c left join opened o on o.seq = c.seq left join steps s on s.step_id = c.p_step_id left join pois p on p.poi_id = c.p_poi_id
"""
_CALL_CTES = dict(v_calls=V.TOOL_CALLS, steps=_STEPS, pois=_POIS, known_calls=_KNOWN_CALLS,
                  opened=_window_sql("known_calls"), called=_CALLED)
_N = dict(v_requests=V.ATTEMPTS, numbered=_NUMBERED)
_STUDENT = "select *, phone as student from numbered"
_EGRESS = r"""
select dest_ip, dest_port, connections, class, case when class = 'violation' then 'FAIL' else 'PASS' end as verdict from (
  select dest_ip, dest_port, count(*) as connections,
    case when regexp_matches(dest_ip, '^(10\.|172\.1[6-9]\.|172\.2[0-9]\.|172\.3[01]\.|192\.168\.|127\.|169\.254\.)') then 'internal'
      when dest_ip in (select ip from allow_list) then 'allow_listed' else 'violation' end as class
  from v_conns group by 1, 2) t
"""
_BIND_KNOWN = """
select b.*, epoch_us(ts) // 1000 as ms, row_number() over (partition by b.phone, kind order by ts, seq) as i
from v_bind b where b.phone in (select phone from registrations where registered)
"""

ORACLES = {
    "access_log_route": V.oracle("""
      , ruled as (select *, case when path = '/api/v1/ai' or path like '/api/v1/ai/%' then '/api/v1/ai'
          when path = '/api/v1/parent/bind' or path like '/api/v1/parent/bind/%' then '/api/v1/parent/bind' end as rule from v_log)
      select seq, rule, rule || case when student_id is not null then ':student:' || student_id else ':ip:' || ip end as rate_key,
        cast(case rule when '/api/v1/ai' then 6 when '/api/v1/parent/bind' then 12 end as int) as retry_after from ruled""", v_log=V.ACCESS),
    "revoked_access": V.oracle("select seq, jti, jti in (select jti from revocations where revoked) as revoked from v_log",
        v_log=V.ACCESS, revocations=V.REVOCATIONS),
    "revoke_by_phone": V.oracle("select phone, count(distinct jti) as tokens from revocations where revoked group by 1", revocations=V.REVOCATIONS),
    "rate_token_bucket": V.oracle(_R + "select seq, allowed, round(tokens, 6) as tokens_left from bucket", **_N, bucket=_BUCKET),
    "rate_anchored_window": V.oracle(_R + f"""
      select seq, used <= {WINDOW_MAX} as allowed, cast(greatest(0, {WINDOW_MAX} - used) as bigint) as remaining, (start_ms + {_W}) // 1000 as reset_epoch,
        case when used <= {WINDOW_MAX} then 0 else (start_ms + {_W} - ms) // 1000 + 1 end as retry_after from opened""",
        **_N, students=_STUDENT, opened=_window_sql("students")),
    "rate_sliding_log": V.oracle(_R + "select seq, allowed from logged", **_N, logged=_log_sql("numbered")),
    "lockout": V.oracle(_R + "select seq, outcome, cast(errors as bigint) as errors, cast(lock_minutes as bigint) as lock_minutes from locks",
        **_N, locks=_lock_sql("numbered")),
    "burst_count": V.oracle(f"""
      select a.seq, count(b.seq) as recent, count(b.seq) >= 3 as limited from numbered a left join numbered b
        on b.phone = a.phone and b.ms > a.ms - {_W} and (b.ms < a.ms or (b.ms = a.ms and b.seq < a.seq)) group by a.seq""", **_N),
    "tool_call_outcome": V.oracle(_R + """
      select seq, tool_name, error_code is null as success, error_code,
        case when error_code is null then coalesce(step_name, poi_name) end as shown_name,
        case when error_code is null then coalesce(page_url, '/pages/map/nav?dest=' || p_poi_id) end as url from called""", **_CALL_CTES),
    "poi_lookup": V.oracle("""
      select seq, p_poi_id as poi_id, poi_name, distance, '/pages/map/nav?dest=' || poi_id as nav_url,
        case when poi_id is null then 'NOT_FOUND' end as poi_error from v_calls left join pois on poi_id = p_poi_id""",
        v_calls=V.TOOL_CALLS, pois=_POIS),
    "tool_error_counts": V.oracle(_R + "select tool_name, error_code, count(*) as calls from called group by 1, 2", **_CALL_CTES),
    "audit_by_student": V.oracle(_R + """
      select student_id, case when length(p_student_id) > 4 then '****' || right(p_student_id, 4) when p_student_id is not null then '****' end as masked_student_id,
        count(*) as calls, count(error_code) as failures, max(ts) as last_call from called group by 1, 2""", **_CALL_CTES),
    "bind_request_outcome": V.oracle(_R + f"""
      select b.seq, b.phone, cast(case when b.phone not in (select phone from registrations where registered) then {C.CODE_NOT_REGISTERED}
        when b.kind = 'verify-code' then case when l.allowed then {C.CODE_OK} else {C.CODE_RATE_LIMITED} end
        when k.outcome = 'ok' then {C.CODE_OK} when k.outcome = 'locked' then {C.CODE_LOCKED} else {C.CODE_WRONG} end as int) as code
      from v_bind b left join logged l on l.seq = b.seq left join locks k on k.seq = b.seq""",
        v_bind=V.BIND_REQUESTS, registrations=V.REGISTRATIONS, known=_BIND_KNOWN,
        asked="select * from known where kind = 'verify-code'", tried="select * from known where kind = 'bind'",
        logged=_log_sql("asked"), locks=_lock_sql("tried")),
    "egress_audit": V.oracle("select * from audited", v_conns=V.CONNECTIONS, allow_list=V.ALLOW_LIST, audited=_EGRESS),
    "egress_violations": V.oracle("select count(*) filter (verdict = 'FAIL') as violations, count(*) as targets from audited",
        v_conns=V.CONNECTIONS, allow_list=V.ALLOW_LIST, audited=_EGRESS),
}
