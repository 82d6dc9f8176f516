"""Change-data-capture queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterflow.catalog import views as V
from rosterflow.functions.times import instant_text
from rosterflow.operators import changes as ops
from rosterflow.operators import monitor
from rosterflow.sources import changes as src


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """The change view with row images and offsets as maps and structs."""
    flat = V.view(spark, sf, V.CDC)
    amount = [F.lit("amount"), F.col("amount")]
    image = F.when(F.col("student_id").isNull(), F.create_map(*amount)).otherwise(
        F.create_map(F.lit("student_id"), F.col("student_id"), *amount))
    offset = F.struct("binlog_file", "binlog_position")
    return flat.select(
        "seq", "source_server", "source_table", "operation",
        F.when(F.col("has_before"), image).alias("before"),
        F.when(F.col("has_after"), image).alias("after"),
        "ts", F.when(F.col("binlog_file").isNotNull(), offset).alias("source_offset"),
        "transaction_id", "sink_result", "latency_ms")


def id_mapping(spark, sf):
    return ops.latest_mapping(V.view(spark, sf, V.ID_MAPPING))


def handled(spark, sf):
    return ops.outcomes(change_log(spark, sf), id_mapping(spark, sf))


def _json_log(spark, sf):
    """The log as JSON; times in turn with Z, with a zone, without one, and as an epoch in milliseconds."""
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    ahead = F.date_format(F.col("ts") + F.make_dt_interval(hours=F.lit(8)), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    at = F.element_at(F.array(
        F.concat(plain, F.lit("Z")), F.concat(ahead, F.lit("+08:00")), plain,
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string")), (F.col("seq") % 4 + 1).cast("int"))
    body = F.to_json(F.struct(
        F.col("source_table").alias("sourceTable"), "operation", "before", "after",
        at.alias("timestamp"),
        F.when(F.col("source_offset").isNotNull(), F.struct(
            F.col("source_offset.binlog_file").alias("binlogFile"),
            F.col("source_offset.binlog_position").alias("binlogPosition"),
            F.concat(F.lit("gtid-"), F.col("seq").cast("string")).alias("gtid"),
            at.alias("timestamp"))).alias("sourceOffset"),
        F.col("transaction_id").alias("transactionId")))
    body = F.regexp_replace(body, '"timestamp":"([0-9]+)"', '"timestamp":$1')
    value = F.when(F.col("source_table") == "", F.lit("{not json")).otherwise(body)
    return change_log(spark, sf).select("seq", value.alias("value"))


def cdc_parse(spark, sf):
    parsed = src.parse_changes(_json_log(spark, sf))
    return parsed.select(
        "seq", "source_table", "operation", F.col("before")["amount"].alias("before_amount"),
        F.col("after")["amount"].alias("after_amount"),
        instant_text(F.col("ts")).alias("at"), instant_text(F.col("offset_ts")).alias("offset_at"), "gtid",
        F.col("source_offset.binlog_file").alias("binlog_file"),
        F.col("source_offset.binlog_position").alias("binlog_position"),
        "transaction_id", "parse_error")


def cdc_unwrap(spark, sf):
    flat = V.view(spark, sf, V.CDC)
    row = F.to_json(F.struct(
        "student_id", "amount", F.when(F.col("operation") == "DELETE", "true").otherwise("false").alias("__deleted")))
    log = flat.select("seq", row.alias("value"))
    tombstones = flat.filter("operation = 'DELETE'").select("seq", F.lit(None).cast("string").alias("value"))
    rows = src.unwrap_flat(log.unionByName(tombstones), "student_id string, amount string")
    return rows.withColumn("amount", F.col("amount").cast("bigint"))


def cdc_effective_image(spark, sf):
    checked = ops.with_image_checks(change_log(spark, sf))
    return checked.select(
        "seq", "operation", F.col("image")["student_id"].alias("student_id"),
        F.col("image")["amount"].alias("amount"), F.col("after")["amount"].alias("after_amount"),
        F.col("before")["amount"].alias("before_amount"), "image_ok")


def cdc_event_id(spark, sf):
    return change_log(spark, sf).select("seq", ops.event_id().alias("event_id"))


def cdc_offset_filter(spark, sf):
    return ops.after_offset(change_log(spark, sf), "mysql-bin.000001", 250000).select("seq", "source_table")


def cdc_enrich(spark, sf):
    log = change_log(spark, sf).withColumn("event_id", ops.event_id())
    return ops.enrich(log, id_mapping(spark, sf)).select(
        "seq", "student_id", "mapping_missing", F.col("record")["id_card"].alias("id_card"),
        F.col("record")["card_id"].alias("card_id"), F.col("record")["amount"].alias("amount"))


def cdc_enrich_asof(spark, sf):
    versions = V.view(spark, sf, V.ID_VERSIONS, v_id_mapping=V.view(spark, sf, V.ID_MAPPING))
    return ops.enrich_as_of(change_log(spark, sf), versions).select(
        "seq", "student_id", "mapping_missing", F.col("record")["id_card"].alias("id_card"),
        F.col("record")["card_id"].alias("card_id"), F.col("record")["amount"].alias("amount"))


def id_mapping_latest(spark, sf):
    return id_mapping(spark, sf)


def id_translate(spark, sf):
    versions = V.view(spark, sf, V.ID_MAPPING)
    every = V.table(spark, sf, "customer").select(
        F.lit("student_id").alias("kind"), F.col("c_custkey").cast("string").alias("value"))
    requests = every.unionByName(versions.select(F.lit("id_card").alias("kind"), F.col("id_card").alias("value")))
    requests = requests.unionByName(
        versions.filter("card_id is not null").select(F.lit("card_id").alias("kind"), F.col("card_id").alias("value")))
    return ops.translate_ids(requests, id_mapping(spark, sf))


def cdc_sink_route(spark, sf):
    return handled(spark, sf).select("seq", "event_id", "target", "sink_result", "outcome")


def cdc_high_water(spark, sf):
    log = change_log(spark, sf)
    committed = F.when(F.col("sink_result") == "SUCCESS", F.col("source_offset"))
    marked = ops.high_water(log, committed)
    return marked.select(
        "seq", F.col("committed_offset.binlog_file").alias("committed_file"),
        F.col("committed_offset.binlog_position").alias("committed_position"), "stale")


def cdc_retry_plan(spark, sf):
    """Writes of every change; the target of every third fails a number of times first, or for good."""
    fails = F.array_repeat(F.lit("RETRY"), (F.col("seq") % 6).cast("int"))
    results = F.when(F.col("seq") % 3 == 0, F.concat(fails, F.array("sink_result"))).otherwise(F.array("sink_result"))
    tries = ops.write_attempts(change_log(spark, sf).withColumn("results", results))
    return tries.select(
        "seq", "attempt", "result", instant_text(F.col("due_at")).alias("due_at"),
        F.when(F.col("last"), ops.attempted_outcome()).alias("outcome"))


def cdc_outcomes(spark, sf):
    return handled(spark, sf).select("seq", "event_id", "outcome")


def cdc_stats(spark, sf):
    counts = ops.sync_stats(handled(spark, sf))
    latency = monitor.latency_percentiles(change_log(spark, sf), "source_server", "seq", "latency_ms")
    return counts.join(latency.select("source_server", "p95_ms", "p99_ms"), "source_server", "left")


def cdc_dead_letter(spark, sf):
    done = handled(spark, sf)
    compensated = done.filter("outcome = 'RETRY_EXHAUSTED' and target = 'dorm-system'").select(
        "source_server", "event_id").distinct()
    return ops.dead_letters(done, compensated)


def sync_counts(spark, sf):
    """Flagship: changes per target and outcome."""
    return handled(spark, sf).groupBy(F.coalesce("target", F.lit("none")).alias("target"), "outcome").agg(
        F.count(F.lit(1)).alias("changes"))


def sink_latency_avg(spark, sf):
    log = change_log(spark, sf).withColumn("target", F.coalesce(ops.target_system(), F.lit("none")))
    return monitor.average_latency(log, "target", "latency_ms")


def latency_percentiles(spark, sf):
    return monitor.latency_percentiles(change_log(spark, sf), "source_server", "seq", "latency_ms")


def _student_rows(spark, sf):
    def fetch(session, table, since):
        return V.table(session, sf, "customer").select(
            F.col("c_custkey").alias("student_id"), "c_name", "c_nationkey")
    return fetch


def _order_rows(spark, sf):
    def fetch(session, table, since):
        return V.table(session, sf, "orders").select(
            "o_orderkey", F.col("o_custkey").alias("student_id"), F.col("o_orderdate").alias("update_time"),
            "o_orderstatus")
    return fetch


def _batch(spark, sf, scanned, sink_result, table):
    routed = ops.enrich(scanned, id_mapping(spark, sf)).withColumns(
        {"target": ops.target_system(), "sink_result": sink_result})
    return ops.batch_result(routed.withColumn("outcome", ops.write_outcome()), (table,))


def batch_full_sync(spark, sf):
    scanned = src.snapshot_scan(spark, _student_rows(spark, sf), "student_info", "student_id", "run-1")
    result = F.when(F.col("after")["c_nationkey"] == "7", "RETRY").otherwise("SUCCESS")
    return _batch(spark, sf, scanned, result, "student_info")


def batch_incremental_sync(spark, sf):
    scanned = src.incremental_scan(
        spark, _order_rows(spark, sf), "checkin_record", "o_orderkey", "run-1", "1999-01-01 00:00:00")
    result = F.when(F.col("after")["o_orderstatus"] == "P", "DEAD_LETTER").otherwise("SUCCESS")
    return _batch(spark, sf, scanned, result, "checkin_record")


QUERIES = {fn.__name__: fn for fn in (
    cdc_parse, cdc_unwrap, cdc_effective_image, cdc_event_id, cdc_offset_filter, cdc_enrich, cdc_enrich_asof, id_mapping_latest,
    id_translate, cdc_sink_route, cdc_high_water, cdc_retry_plan, cdc_outcomes, cdc_stats, cdc_dead_letter, sync_counts,
    sink_latency_avg, latency_percentiles, batch_full_sync, batch_incremental_sync)}

_AT = V.instant("ts")
_IMAGE = """'{' || case when student_id is null then '' else '"student_id":"' || student_id || '",' end
    || '"amount":"' || amount || '"}'"""
_ROW = f"""'row-' || md5('{{' || concat_ws(',', case when has_before then '"before":' || {_IMAGE} end,
    case when has_after then '"after":' || {_IMAGE} end) || '}}')"""
_EVENT_ID = f"""case when binlog_file is not null
    then binlog_file || ':' || cast(binlog_position as string) || ':' || source_table || ':' || operation
  when transaction_id is not null then transaction_id || ':' || source_table || ':' || operation
  else source_table || ':' || operation || ':' || coalesce({_AT}, {_ROW}) end"""
_TARGET = """case when source_table = '' then null when source_table like 'dorm\\_%' escape '\\' then 'dorm-system'
  when source_table like 'card\\_%' escape '\\' then 'card-system' else 'edu-system' end"""
_IDENTIFIED = f"""
select c.*, {_EVENT_ID} as event_id, {_TARGET} as target,
       binlog_file || '/' || lpad(cast(binlog_position as string), 12, '0') as offset_key,
       case when has_after or has_before then student_id end as image_student
from v_cdc c
"""
_ENRICHED = """
select i.*, m.student_id is null and image_student is not null as mapping_missing, m.id_card, m.card_id
from identified i left join id_latest m on m.student_id = i.image_student
"""
_OWN = """
select *, case when mapping_missing then 'MAPPING_MISSING' when target is null then 'DEAD_LETTER'
    when sink_result = 'SUCCESS' then 'SUCCESS' when sink_result = 'DEAD_LETTER' then 'DEAD_LETTER'
    else 'RETRY_EXHAUSTED' end as own_outcome,
  row_number() over (partition by source_server, event_id order by seq) > 1 as is_copy
from enriched
"""
_HANDLED = """
select *, case when is_copy or coalesce(offset_key <= max(case when not is_copy and own_outcome = 'SUCCESS' then offset_key end)
    over (partition by source_server order by seq rows between unbounded preceding and 1 preceding), false)
  then 'SKIPPED_DUPLICATE' else own_outcome end as outcome
from own
"""
_CTES = dict(v_cdc=V.CDC, v_id_mapping=V.ID_MAPPING, id_latest=V.ID_LATEST, identified=_IDENTIFIED,
             enriched=_ENRICHED, own=_OWN, handled=_HANDLED)
_RANKED_LATENCY = """
select source_server, latency_ms, row_number() over (partition by source_server order by latency_ms) as r,
       count(*) over (partition by source_server) as n
from (select *, row_number() over (partition by source_server order by seq desc) as rn from v_cdc) t
where rn <= 1000
"""
_PERCENTILES = """
select source_server, max(n) as samples,
  max(case when r = cast(ceil(0.95::double * n) as bigint) then latency_ms end) as p95_ms,
  max(case when r = cast(ceil(0.99::double * n) as bigint) then latency_ms end) as p99_ms
from ranked_latency group by source_server
"""

ORACLES = {
    "cdc_parse": V.oracle(f"""
      select seq, case when source_table <> '' then source_table end as source_table,
        case when source_table <> '' then operation end as operation,
        case when has_before and source_table <> '' then amount end as before_amount,
        case when has_after and source_table <> '' then amount end as after_amount,
        case when source_table <> '' then {_AT} end as at,
        case when source_table <> '' and binlog_file is not null then {_AT} end as offset_at,
        case when source_table <> '' and binlog_file is not null then 'gtid-' || cast(seq as string) end as gtid,
        case when source_table <> '' then binlog_file end as binlog_file,
        case when source_table <> '' then binlog_position end as binlog_position,
        case when source_table <> '' then transaction_id end as transaction_id,
        source_table = '' as parse_error from v_cdc""", v_cdc=V.CDC),
    "cdc_unwrap": V.oracle("""
      select seq, student_id, cast(amount as bigint) as amount,
        case when operation = 'DELETE' then 'DELETE' else 'UPSERT' end as operation from v_cdc""", v_cdc=V.CDC),
    "cdc_effective_image": V.oracle("""
      select seq, operation, case when has_after or has_before then student_id end as student_id,
        case when has_after or has_before then amount end as amount,
        case when has_after then amount end as after_amount, case when has_before then amount end as before_amount,
        case when operation = 'DELETE' then has_before and not has_after else has_after end as image_ok
      from v_cdc""", v_cdc=V.CDC),
    "cdc_event_id": V.oracle("select seq, event_id from identified", v_cdc=V.CDC, identified=_IDENTIFIED),
    "cdc_offset_filter": V.oracle("""
      select seq, source_table from v_cdc where binlog_file is null or binlog_file > 'mysql-bin.000001'
        or (binlog_file = 'mysql-bin.000001' and binlog_position > 250000)""", v_cdc=V.CDC),
    "cdc_enrich": V.oracle("""
      select seq, image_student as student_id, mapping_missing, id_card, card_id,
        case when (has_after or has_before) and not mapping_missing then amount end as amount from enriched""",
        **{k: _CTES[k] for k in ("v_cdc", "v_id_mapping", "id_latest", "identified", "enriched")}),
    "cdc_enrich_asof": V.oracle("""
      , held as (
        select i.*, m.student_id is not null and m.active as known, m.id_card, m.card_id
        from identified i asof left join id_versions m on m.student_id = i.image_student and m.ts <= i.ts)
      select seq, image_student as student_id, image_student is not null and not known as mapping_missing,
        case when known then id_card end as id_card, case when known then card_id end as card_id,
        case when (has_after or has_before) and (image_student is null or known) then amount end as amount from held""",
        **{k: _CTES[k] for k in ("v_cdc", "v_id_mapping", "identified")}, id_versions=V.ID_VERSIONS),
    "id_mapping_latest": V.oracle("select * from id_latest", v_id_mapping=V.ID_MAPPING, id_latest=V.ID_LATEST),
    "id_translate": V.oracle("""
      select 'student_id' as kind, cast(c_custkey as string) as value, m.id_card as result
      from customer c left join id_latest m on m.student_id = cast(c.c_custkey as string)
      union all select 'id_card', v.id_card, m.student_id from v_id_mapping v left join id_latest m on m.id_card = v.id_card
      union all select 'card_id', v.card_id, m.student_id from v_id_mapping v left join id_latest m on m.card_id = v.card_id
      where v.card_id is not null""", v_id_mapping=V.ID_MAPPING, id_latest=V.ID_LATEST),
    "cdc_sink_route": V.oracle("select seq, event_id, target, sink_result, outcome from handled", **_CTES),
    "cdc_high_water": V.oracle("""
      select seq, substr(hw, 1, 16) as committed_file, cast(substr(hw, 18) as bigint) as committed_position,
        coalesce(offset_key <= hw, false) as stale
      from (select *, max(case when sink_result = 'SUCCESS' then offset_key end) over (partition by source_server
        order by seq rows between unbounded preceding and 1 preceding) as hw from identified) t""",
        v_cdc=V.CDC, identified=_IDENTIFIED),
    "cdc_retry_plan": V.oracle(f"""
      , answers as (
          select *, case when seq % 3 = 0 then seq % 6 else 0 end as fails from v_cdc),
        tries as (
          select *, unnest(range(0, 4)) as attempt from answers),
        answered as (
          select * exclude (ts), case when attempt < fails then 'RETRY' else sink_result end as result,
            ts + case attempt when 0 then 0 when 1 then 10 when 2 then 40 else 100 end * interval 1 second as ts
          from tries where attempt <= fails or sink_result = 'RETRY')
      select seq, cast(attempt as int) as attempt, result, {_AT} as due_at,
        case when result <> 'RETRY' then result when attempt = 3 then 'RETRY_EXHAUSTED' end as outcome
      from answered""", v_cdc=V.CDC),
    "cdc_outcomes": V.oracle("select seq, event_id, outcome from handled", **_CTES),
    "cdc_stats": V.oracle("""
      select h.source_server, count(*) as total_events, count(*) filter (outcome = 'SUCCESS') as success_count,
        count(*) filter (outcome in ('DEAD_LETTER', 'MAPPING_MISSING', 'RETRY_EXHAUSTED')) as failure_count,
        count(*) filter (outcome in ('DEAD_LETTER', 'MAPPING_MISSING', 'RETRY_EXHAUSTED')) as dead_letter_count,
        count(*) filter (outcome = 'SKIPPED_DUPLICATE') as skipped_count,
        max(p95_ms) as p95_ms, max(p99_ms) as p99_ms
      from handled h join percentiles p on p.source_server = h.source_server group by h.source_server""",
        **_CTES, ranked_latency=_RANKED_LATENCY, percentiles=_PERCENTILES),
    "cdc_dead_letter": V.oracle("""
      , failed as (select *, case outcome
            when 'MAPPING_MISSING' then 'MappingMissing: student_id=' || image_student
            when 'DEAD_LETTER' then 'SinkDeadLetter: ' || source_table
            else 'RetryExhausted: table=' || source_table end as reason
          from handled where outcome in ('MAPPING_MISSING', 'DEAD_LETTER', 'RETRY_EXHAUSTED')),
        last as (select *, row_number() over (partition by source_server, event_id order by seq desc) as rn from failed)
      select source_server, event_id, source_table, reason, seq from last l where rn = 1 and not exists (
        select 1 from handled h where h.outcome = 'RETRY_EXHAUSTED' and h.target = 'dorm-system'
          and h.event_id = l.event_id and h.source_server = l.source_server)""", **_CTES),
    "sync_counts": V.oracle("""
      select coalesce(target, 'none') as target, outcome, count(*) as changes from handled group by 1, 2""", **_CTES),
    "sink_latency_avg": V.oracle("""
      select coalesce(target, 'none') as target, count(*) as writes, cast(sum(latency_ms) // count(*) as bigint) as avg_latency_ms
      from identified group by 1""", v_cdc=V.CDC, identified=_IDENTIFIED),
    "latency_percentiles": V.oracle("select *, p95_ms <= 5000 as healthy from percentiles",
        v_cdc=V.CDC, ranked_latency=_RANKED_LATENCY, percentiles=_PERCENTILES),
    "batch_full_sync": V.oracle("""
      select 'student_info' as source_table, count(*) filter (m.student_id is not null and c_nationkey <> 7) as synced,
        count(*) filter (m.student_id is null or c_nationkey = 7) as failed
      from customer left join id_latest m on m.student_id = cast(c_custkey as string)""",
        v_id_mapping=V.ID_MAPPING, id_latest=V.ID_LATEST),
    "batch_incremental_sync": V.oracle("""
      select 'checkin_record' as source_table, count(*) filter (m.student_id is not null and o_orderstatus <> 'P') as synced,
        count(*) filter (m.student_id is null or o_orderstatus = 'P') as failed
      from orders left join id_latest m on m.student_id = cast(o_custkey as string)
      where o_orderdate > timestamp '1999-01-01 00:00:00'""", v_id_mapping=V.ID_MAPPING, id_latest=V.ID_LATEST),
}
