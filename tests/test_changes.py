"""Change-capture rules on small logs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.functions.times import instant_text
from rosterflow.operators import changes as ops
from rosterflow.operators import events, monitor
from rosterflow.sources import changes as src

SCHEMA = ("seq bigint, source_server string, source_table string, operation string, before map<string,string>, "
          "after map<string,string>, ts timestamp_ntz, source_offset struct<binlog_file:string,binlog_position:bigint>, "
          "transaction_id string, sink_result string")
NOW = dt.datetime(2026, 9, 1, 8)


def change(seq, position, student="s1", table="student_info", op="INSERT", result="SUCCESS", file="mysql-bin.000003", after=True):
    image = {"student_id": student, "name": "n"} if student else {"name": "n"}
    offset = (file, position) if position is not None else None
    return (seq, "srv", table, op, None if after else image, image if after else None, NOW, offset, None, result)


def handle(spark, rows, block_rows=2):
    log = spark.createDataFrame(rows, SCHEMA)
    mapping = spark.createDataFrame([("s1", "id1", "card1"), ("s2", "id2", None)], "student_id string, id_card string, card_id string")
    return ops.outcomes(log, mapping, block_rows=block_rows)


def outcome_list(df):
    return [r.outcome for r in df.orderBy("seq").collect()]


def test_outcomes_in_order(spark):
    rows = [
        change(0, 1000), change(1, 1001, result="RETRY"), change(2, 900), change(3, 1002, student="s9"),
        change(4, 1003, table=""), change(5, 1001, result="SUCCESS"), change(6, 10, file="mysql-bin.000004"),
        change(7, 2000), change(8, None, table="dorm_allocation"), change(9, None, table="dorm_allocation"),
        change(10, 20, result="DEAD_LETTER", file="mysql-bin.000004"), change(11, 30, student=None, file="mysql-bin.000004"),
    ]
    assert outcome_list(handle(spark, rows)) == [
        C.SUCCESS, C.RETRY_EXHAUSTED, C.SKIPPED_DUPLICATE, C.MAPPING_MISSING, C.DEAD_LETTER, C.SKIPPED_DUPLICATE, C.SUCCESS,
        C.SKIPPED_DUPLICATE, C.SUCCESS, C.SKIPPED_DUPLICATE, C.DEAD_LETTER, C.SUCCESS]


def test_failures_do_not_move_the_offset(spark):
    rows = [change(0, 500, result="RETRY"), change(1, 400), change(2, 450, student="s9"), change(3, 420)]
    assert outcome_list(handle(spark, rows)) == [C.RETRY_EXHAUSTED, C.SUCCESS, C.MAPPING_MISSING, C.SUCCESS]


def test_stats_and_dead_letters(spark):
    rows = [change(0, 1), change(1, 2, result="RETRY"), change(2, 3, student="s9"), change(3, 4, table=""), change(4, 1)]
    handled = handle(spark, rows)
    stats = ops.sync_stats(handled).first()
    assert (stats.total_events, stats.success_count, stats.failure_count, stats.dead_letter_count, stats.skipped_count) == (5, 1, 3, 3, 1)
    reasons = {r.reason for r in ops.dead_letters(handled).collect()}
    assert reasons == {"RetryExhausted: table=student_info", "MappingMissing: student_id=s9", "SinkDeadLetter: "}
    done = ops.dead_letters(handled).filter(F.col("reason").startswith("Retry")).select("source_server", "event_id")
    assert ops.dead_letters(handled, done).count() == 2


def test_enrichment_keeps_absent_parts_out(spark):
    got = {r.seq: r.record for r in handle(spark, [change(0, 1, "s2"), change(1, 2, None), change(2, 3, "s1")]).collect()}
    assert got == {0: {"student_id": "s2", "name": "n", "id_card": "id2"}, 1: {"name": "n"},
                   2: {"student_id": "s1", "name": "n", "id_card": "id1", "card_id": "card1"}}


def test_event_ids(spark):
    rows = [change(0, 7), change(1, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(
        "transaction_id", F.when(F.col("seq") == 0, F.lit("tx")).otherwise(F.lit(None)))
    assert [r.e for r in df.select(ops.event_id().alias("e"), "seq").orderBy("seq").collect()] == [
        "mysql-bin.000003:7:student_info:INSERT", "student_info:INSERT:2026-09-01T08:00:00Z"]


def test_percentiles_by_nearest_rank(spark):
    samples = spark.createDataFrame(
        [("a", i, 100 if i < 9 else 1000) for i in range(10)] + [("b", i, 100 if i < 98 else 5000) for i in range(100)]
        + [("c", i, 9999 if i < 500 else 1) for i in range(1500)], "s string, seq bigint, ms bigint")
    got = {r.s: (r.samples, r.p95_ms, r.p99_ms, r.healthy) for r in monitor.latency_percentiles(samples, "s", "seq", "ms").collect()}
    assert got == {"a": (10, 1000, 1000, True), "b": (100, 100, 5000, True), "c": (1000, 1, 1, True)}


def test_unwrap_drops_tombstones(spark):
    raw = spark.createDataFrame([('{"id":"1","__deleted":"false"}',), ('{"id":"2","__deleted":"true"}',), (None,)], "value string")
    assert sorted((r.id, r.operation) for r in src.unwrap_flat(raw, "id string").collect()) == [("1", "UPSERT"), ("2", "DELETE")]


def test_incremental_scan_pushes_the_watermark(spark, sf):
    def fetch(session, table, since):
        return session.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderdate").alias("update_time"))
    scanned = src.incremental_scan(spark, fetch, "t", "o_orderkey", "r", "1999-01-01 00:00:00")
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderdate,1999-01-01" in plan
    everything = src.incremental_scan(spark, fetch, "t", "o_orderkey", "r", None)
    assert everything.count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_handlers_per_queue(spark):
    df = spark.createDataFrame([("q.card.issue", "a"), ("q.edu.register", "b")], "queue string, event_id string")
    got = events.apply_handlers(df, {"q.edu.register": lambda d: F.lit("NON_RETRYABLE")})
    assert {r.queue: r.handler_result for r in got.collect()} == {"q.card.issue": "OK", "q.edu.register": "NON_RETRYABLE"}


def chain(spark, *types):
    return spark.createDataFrame(
        [("s", f"e{i}", t, i) for i, t in enumerate(types)], "student_id string, event_id string, event_type string, seq bigint")


def test_chain_order(spark):
    a, p, v, d = C.EVENT_TYPES
    for types, ordered in [((a, p, v, d), True), ((a, v, p), True), ((a,), True), ((p, a), False), ((a, p, d, v), False),
                           ((a, d), True), ((d, a), False), ((p, v), False)]:
        assert events.chain_ordered(chain(spark, *types)).first().ordered is ordered
    checks = events.completion_check(chain(spark, a, d, p, v, d)).orderBy("seq").collect()
    assert [r.prerequisites_met for r in checks] == [False, True]


def test_tool_call_log(spark, sf, tmp_path):
    from rosterflow.catalog import access
    from rosterflow.sources import audit
    outcomes = access._outcomes(spark, sf)
    path = str(tmp_path / "log")
    audit.append_calls(outcomes.filter("seq < 500"), path)
    audit.append_calls(outcomes.filter("seq >= 500"), path)
    mine = audit.calls_of(spark, path, "3")
    assert mine.count() == outcomes.filter("student_id = '3'").count() > 0
    shown = {r.s for r in mine.select(F.col("params")["student_id"].alias("s")).collect()}
    assert shown <= {None, "****", "****0003"}


def test_targets_are_partitioned(spark, tmp_path):
    from rosterflow.streaming.sync import sync_handler
    rows = [change(0, 1), change(1, 2, table="dorm_allocation"), change(2, 3, student="s9")]
    mapping = spark.createDataFrame([("s1", "id1", "card1")], "student_id string, id_card string, card_id string")
    handler = sync_handler(mapping, str(tmp_path), lambda df: df.withColumn("sink_result", F.lit("SUCCESS")))
    tables = {name: ([tuple(r) for r in df.collect()], by) for name, df, *by in handler(spark.createDataFrame(rows, SCHEMA), 0)}
    assert {r[0] for r in tables["targets"][0]} == {"edu-system", "dorm-system"} and tables["targets"][1] == ["target"]
    assert len(tables["dead_letters"][0]) == 1 and len(tables["outcomes"][0]) == 3


def _raw(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "seq bigint, value string")


@pytest.mark.parametrize("text, shown", [
    ('"2026-09-01T08:00:00.123Z"', "2026-09-01T08:00:00.123Z"), ('"2026-09-01T16:00:00.123456+08:00"', "2026-09-01T08:00:00.123456Z"),
    ('"2026-09-01T08:00:00"', "2026-09-01T08:00:00Z"), ("1788249600123", "2026-09-01T08:00:00.123Z"), ("1788249600", "2026-09-01T08:00:00Z"),
    ("1788249600.5", "2026-09-01T08:00:00.500Z"), ('"soon"', None), ("null", None)])
def test_times_keep_zone_and_fraction(spark, text, shown):
    body = '{"sourceTable":"t","operation":"UPDATE","timestamp":%s,"sourceOffset":{"gtid":"g","timestamp":%s}}' % (text, text)
    row = src.parse_changes(_raw(spark, body)).select(
        instant_text(F.col("ts")).alias("at"), instant_text(F.col("offset_ts")).alias("offset_at"), "gtid").first()
    assert (row.at, row.offset_at, row.gtid) == (shown, shown, "g")


def test_changes_a_millisecond_apart_are_two_changes(spark):
    times = ['"2026-09-01T08:00:00.123Z"', '"2026-09-01T08:00:00.124Z"', "null", "null", "null"]
    rows = ['{"a":"1"}', '{"a":"1"}', '{"a":"1"}', '{"a":"2"}', '{"a":"2"}']
    raw = _raw(spark, *['{"sourceTable":"t","operation":"UPDATE","after":%s,"timestamp":%s}' % x for x in zip(rows, times)])
    log = src.parse_changes(raw).withColumn("source_server", F.lit("s")).withColumn("sink_result", F.lit("SUCCESS"))
    mapping = spark.createDataFrame([], "student_id string, id_card string, card_id string")
    got = {r.seq: r.outcome for r in ops.outcomes(log, mapping).collect()}
    assert got == {0: "SUCCESS", 1: "SUCCESS", 2: "SUCCESS", 3: "SUCCESS", 4: "SKIPPED_DUPLICATE"}


def test_a_mapping_that_is_no_longer_active_is_none(spark):
    versions = spark.createDataFrame([(1, "a", "i1", "c1", True), (2, "a", "i2", "c2", False), (1, "b", "i3", "c3", True)],
                                     "seq bigint, student_id string, id_card string, card_id string, active boolean")
    assert [r.student_id for r in ops.latest_mapping(versions).collect()] == ["b"]


def test_writes_are_tried_four_times_at_most(spark):
    given = [(1, ["SUCCESS"]), (2, ["RETRY", "RETRY", "SUCCESS", "RETRY"]), (3, ["RETRY"]), (4, ["RETRY", "DEAD_LETTER"]), (5, None), (6, [None])]
    changes = spark.createDataFrame(given, "seq bigint, results array<string>").withColumn(
        "ts", F.lit("2026-09-01 08:00:00").cast("timestamp_ntz"))
    tries = ops.write_attempts(changes).withColumn("outcome", F.when(F.col("last"), ops.attempted_outcome()))
    got = {}
    for r in tries.orderBy("seq", "attempt").collect():
        got.setdefault(r.seq, []).append((r.result, (r.due_at.minute * 60 + r.due_at.second), r.outcome))
    spent = [("RETRY", 0, None), ("RETRY", 10, None), ("RETRY", 40, None), ("RETRY", 100, "RETRY_EXHAUSTED")]
    assert got == {1: [("SUCCESS", 0, "SUCCESS")], 2: [*spent[:2], ("SUCCESS", 40, "SUCCESS")], 3: spent,
                   4: [spent[0], ("DEAD_LETTER", 10, "DEAD_LETTER")], 5: spent, 6: spent}


def test_mapping_as_of_the_change(spark):
    import random

    rng = random.Random(8)
    versions = [(v, "hot" if v % 2 else f"s{v % 5}", f"id{v}", f"card{v}" if v % 3 else None, v % 7 != 0,
                 dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(400))) for v in range(60)]
    log = [(c, "srv", rng.choice(["hot", "s2", "s9", None]), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(-10, 420)) if c % 11 else None)
           for c in range(300)]
    changes = spark.createDataFrame(log, "seq bigint, source_server string, student_id string, ts timestamp_ntz").select(
        "seq", "source_server", "ts", F.lit("INSERT").alias("operation"), F.lit(None).cast("map<string,string>").alias("before"),
        F.when(F.col("student_id").isNotNull(), F.create_map(F.lit("student_id"), F.col("student_id"))).alias("after"))
    given = spark.createDataFrame(versions, "seq bigint, student_id string, id_card string, card_id string, active boolean, ts timestamp_ntz")
    got = {r.seq: (r.mapping_missing, (r.record or {}).get("id_card"), (r.record or {}).get("card_id"))
           for r in ops.enrich_as_of(changes, given, block_ms=3_600_000).collect()}
    want = {}
    for seq, _, student, ts in log:
        held = max(((v[5], v[0], v) for v in versions if ts and v[1] == student and v[5] <= ts), default=None)
        known = held is not None and held[2][4]
        want[seq] = (student is not None and not known, held[2][2] if known else None, held[2][3] if known else None)
    assert got == want and len(set(w[0] for w in want.values())) == 2
