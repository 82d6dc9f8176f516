"""Streaming forms give the results of the batch forms, also after a restart."""

import json
import os
import resource

import pytest
from pyspark.sql import functions as F

from rosterflow.catalog import access as access_q
from rosterflow.catalog import changes as changes_q
from rosterflow.catalog import events as events_q
from rosterflow.catalog import retrieval as retrieval_q
from rosterflow.operators import events, limits, monitor, progress
from rosterflow.operators.folds import epoch_millis
from rosterflow.sources import changes as src
from rosterflow.streaming import stateful
from rosterflow.streaming.batches import _runs, read_batches, read_merged, read_state, run_batches
from rosterflow.streaming.events import (
    HOURS_SCHEMA, STEP_SCHEMA, arrivals_handler, consume_handler, current_steps, dedupe_stream, expiry_handler,
    merged_progress_handler, progress_handler)
from rosterflow.streaming.sync import deliver, latency_handler, running_latency, running_stats, sync_handler, together


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def as_stream(spark, df, folder, parts=3, order="seq", per_trigger=1):
    """Writes ``df`` in arrival order to ``parts`` files and reads them one per trigger."""
    total = df.agg(F.max(order)).first()[0] + 1
    for part in range(parts):
        low, high = total * part // parts, total * (part + 1) // parts
        chunk = df.filter((F.col(order) >= low) & (F.col(order) < high))
        chunk.coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, f"p{part}"))
        for name in os.listdir(os.path.join(folder, f"p{part}")):
            if name.endswith(".parquet"):
                path = os.path.join(folder, f"p{part}", name)
                os.utime(path, (1_700_000_000 + part, 1_700_000_000 + part))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_trigger).parquet(
        os.path.join(folder, "p*"))


def run(stream, root, handler):
    query = run_batches(stream, handler, os.path.join(root, "out"), os.path.join(root, "ckpt"))
    query.awaitTermination()
    return os.path.join(root, "out")


def collect_stream(stream, spark, root):
    out = os.path.join(root, "rows")
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", os.path.join(root, "ckpt2")).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(out)


def test_change_sync_matches_batch_and_resumes(spark, sf, tmp_path):
    log = changes_q.change_log(spark, sf).drop("latency_ms")
    mapping = changes_q.id_mapping(spark, sf)
    root = str(tmp_path / "job")
    out_dir = os.path.join(root, "out")
    answers = log.select("source_server", "seq", "sink_result")
    handler = sync_handler(
        mapping, out_dir, lambda df: df.join(answers, ["source_server", "seq"]), horizon_hours=24 * 36_500)
    calls = []

    def failing(batch, batch_id):
        calls.append(batch_id)
        if batch_id == 1 and calls.count(1) == 1:
            raise RuntimeError("lost")
        return handler(batch, batch_id)

    stream = as_stream(spark, log, str(tmp_path / "in"))
    try:
        run(stream, root, failing)
    except Exception:  # the first run stops in its second batch
        pass
    run(stream, root, failing)
    assert calls.count(0) == 1 and calls.count(1) == 2
    schema = "seq bigint, source_server string, event_id string, outcome string"
    streamed = read_batches(spark, out_dir, "outcomes", schema)
    assert rows(streamed, "seq", "outcome") == rows(changes_q.handled(spark, sf), "seq", "outcome")
    counters = "source_server string, total_events bigint, success_count bigint, skipped_count bigint"
    totals = running_stats(read_batches(spark, out_dir, "stats", counters))
    expected = changes_q.cdc_stats(spark, sf)
    assert rows(totals, "source_server", "total_events", "success_count", "skipped_count") == rows(
        expected, "source_server", "total_events", "success_count", "skipped_count")


@pytest.mark.parametrize("parts", [1, 6])
def test_sink_gets_every_change_once(spark, sf, tmp_path, parts):
    log = changes_q.change_log(spark, sf).drop("latency_ms")
    answers = log.select("source_server", "seq", "sink_result")
    root, got = str(tmp_path / "job"), []

    def sink(changes):
        got.extend(changes.select("target", "event_id", "seq", F.col("record").isNotNull().alias("mapped")).collect())
        return changes.join(answers, ["source_server", "seq"])

    out = run(as_stream(spark, log, str(tmp_path / "in"), parts), root, sync_handler(
        changes_q.id_mapping(spark, sf), os.path.join(root, "out"), sink, horizon_hours=24 * 36_500))
    keys = [(r.target, r.event_id, r.seq) for r in got]
    assert len(keys) == len(set(keys)) and all(r.target and r.mapped for r in got)
    streamed = read_batches(spark, out, "outcomes", "seq bigint, source_server string, event_id string, outcome string")
    want = changes_q.handled(spark, sf)
    assert rows(streamed, "seq", "outcome") == rows(want, "seq", "outcome")
    written = want.filter(F.col("outcome").isin("SUCCESS", "RETRY_EXHAUSTED") | (
        (F.col("outcome") == "DEAD_LETTER") & F.col("target").isNotNull()))
    assert sorted(r.seq for r in got) == sorted(r.seq for r in written.select("seq").collect())


def test_deliver_waits_for_results_that_decide_later_writes(spark):
    changes = spark.createDataFrame(
        [("s", 1, ("f", 5)), ("s", 2, ("f", 3)), ("s", 3, ("f", 9)), ("s", 4, ("f", 8)), ("s", 5, None), ("s", 6, ("f", 7))],
        "source_server string, seq bigint, source_offset struct<binlog_file:string,binlog_position:bigint>")
    rounds = []

    def sink(rows):
        rounds.append(sorted(r.seq for r in rows.collect()))
        return rows.withColumn("sink_result", F.when(F.col("seq").isin(1, 6), "SUCCESS").otherwise("RETRY"))

    done = {r.seq: r.sink_result for r in deliver(changes, sink).collect()}
    assert rounds == [[1, 3, 5], [4], [6]]
    assert done == {1: "SUCCESS", 2: None, 3: "RETRY", 4: "RETRY", 5: "RETRY", 6: "SUCCESS"}


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_copies_in_other_batches_never_reach_the_handler(spark, tmp_path, parts):
    rows_in = [(i, "q", f"e{i % 7}", 0, f"t{i % 7}") for i in range(30)]
    view = spark.createDataFrame(rows_in, "seq bigint, queue string, event_id string, retry_count int, event_type string")
    view = view.withColumn("ts", F.timestamp_millis(F.col("seq") * 1000).cast("timestamp_ntz"))
    root, met = str(tmp_path / "job"), []

    def handler(deliveries):
        met.extend(r.event_id for r in deliveries.collect())
        return deliveries.withColumn("handler_result", F.lit("OK"))

    out = run(as_stream(spark, view, str(tmp_path / "in"), parts), root, consume_handler(handler, os.path.join(root, "out")))
    assert sorted(met) == [f"e{i}" for i in range(7)]
    consumed = read_batches(spark, out, "consumed", "seq bigint, action string")
    want = events.consume(view.withColumn("handler_result", F.lit("OK")))
    assert rows(consumed, "seq", "action") == rows(want, "seq", "action")


def test_dedupe_stream_keeps_first_copies(spark, sf, tmp_path):
    view = events_q.events_view(spark, sf).select("seq", "event_id", "ts")
    stream = as_stream(spark, view, str(tmp_path / "in"))
    kept = collect_stream(dedupe_stream(stream, ["event_id"], "ts"), spark, str(tmp_path))
    assert rows(kept, "event_id") == rows(view.select("event_id").distinct(), "event_id")


def test_retries_come_back_until_they_are_exhausted(spark, sf, tmp_path):
    view = events.fan_out(events_q.events_view(spark, sf)).withColumn(
        "handler_result", F.when(F.col("queue") == "q.card.issue", "RETRYABLE").otherwise("OK")).withColumn(
        "retry_count", F.lit(2)).drop("value")
    stream = as_stream(spark, view, str(tmp_path / "in"), parts=4)
    root = str(tmp_path / "job")
    out = run(stream, root, consume_handler(lambda df: df, os.path.join(root, "out")))
    schema = "seq bigint, queue string, event_id string, retry_count int, action string"
    consumed = read_batches(spark, out, "consumed", schema).filter("queue = 'q.card.issue'")
    first = consumed.filter("retry_count = 2 and action = 'RETRY'").count()
    second = consumed.filter("retry_count = 3 and action = 'DEAD_LETTER'").count()
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in view.schema.fields)
    waiting = read_batches(spark, out, "waiting", fields + ", due_at timestamp_ntz")
    left = waiting.filter(F.col("batch_id") == waiting.agg(F.max("batch_id")).first()[0]).count()
    assert first > 0 and second > 0 and first == second + left


def test_progress_stream_matches_batch(spark, sf, tmp_path):
    view = events_q.events_view(spark, sf)
    stream = as_stream(spark, view, str(tmp_path / "in"))
    out = run(stream, str(tmp_path / "job"), progress_handler)
    state = current_steps(read_batches(spark, out, "steps", STEP_SCHEMA))
    assert rows(state, "student_id", "step_code", "completed_at") == rows(
        progress.latest_steps(view), "student_id", "step_code", "completed_at")


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_expiry_stream_is_the_same_however_it_is_cut(spark, sf, tmp_path, parts):
    view = events.fan_out(events_q.events_view(spark, sf)).select("seq", "queue", "event_id", "ts")
    view = view.withColumn("ts", F.timestamp_millis(F.col("seq") * 600_000).cast("timestamp_ntz"))
    stream = as_stream(spark, view, str(tmp_path / "in"), parts)
    root = str(tmp_path / "job")
    out = run(stream, root, expiry_handler(os.path.join(root, "out"), ttl_hours=40, max_length=60))
    want = events.queue_state(view, view.agg(F.max("ts").alias("m")).select("m").scalar(), 40, 60)
    live = read_state(spark, out, "live", "seq bigint, queue string", parts)
    dropped = read_batches(spark, out, "dropped", "seq bigint, queue string, state string")
    assert rows(live, "seq", "queue") == rows(want.filter("state = 'live'"), "seq", "queue")
    assert rows(dropped, "seq", "queue") == rows(want.filter("state <> 'live'"), "seq", "queue")
    assert 0 < live.count() < view.count() and want.select("state").distinct().count() == 3


def test_limit_streams_match_batch(spark, sf, tmp_path):
    requests = access_q._requests(spark, sf)
    stream = as_stream(spark, requests, str(tmp_path / "in"))
    bucket = stateful.limit_stream(
        stream, "phone", "tokens double, spent bigint",
        limits.token_bucket_step(access_q.BUCKET, access_q.REFILL_PER_MINUTE))
    got = collect_stream(bucket, spark, str(tmp_path / "a")).withColumn("allowed", F.col("spent") == 1)
    assert rows(got, "seq", "allowed") == rows(access_q.rate_token_bucket(spark, sf), "seq", "allowed")
    windows = stateful.limit_stream(
        stream, "phone", "window_start bigint, used_before bigint", limits.anchored_window_step(access_q.WINDOW_SECONDS * 1000))
    got = collect_stream(windows, spark, str(tmp_path / "c")).withColumn("allowed", F.col("used_before") < access_q.WINDOW_MAX)
    want = limits.anchored_window(requests, "phone", access_q.WINDOW_MAX, access_q.WINDOW_SECONDS)
    assert rows(got, "seq", "allowed") == rows(want, "seq", "allowed")
    logs = stateful.limit_stream(
        stream, "phone", "accepted bigint", limits.sliding_log_step(access_q.LOG_MAX, access_q.LOG_SECONDS * 1000))
    got = collect_stream(logs, spark, str(tmp_path / "d")).withColumn("allowed", F.col("accepted") == 1)
    want = limits.sliding_log(requests, "phone", access_q.LOG_MAX, access_q.LOG_SECONDS)
    assert rows(got, "seq", "allowed") == rows(want, "seq", "allowed")
    locks = stateful.limit_stream(
        stream, "phone", "outcome string, errors bigint, lock_minutes bigint",
        limits.lockout_step(access_q.MAX_ERRORS, access_q.LOCK_SECONDS * 1000))
    got = collect_stream(locks, spark, str(tmp_path / "b"))
    assert rows(got, "seq", "outcome", "errors") == rows(access_q.lockout(spark, sf), "seq", "outcome", "errors")


def test_chain_and_context_streams_match_batch(spark, sf, tmp_path):
    records = events.chain_records(events_q.events_view(spark, sf))
    stream = as_stream(spark, records, str(tmp_path / "in"))
    checked = stateful.run_steps(stream, "student_id", ["seq"], "met boolean", stateful.chain_step)
    got = collect_stream(checked, spark, str(tmp_path / "a")).filter("event_type = 'student.checkin.completed'")
    assert rows(got, "seq", "met") == rows(events_q.completion_prereq(spark, sf), "seq", "prerequisites_met")

    turns = retrieval_q.turns(spark, sf).filter("role <> 'system'")
    turns = turns.withColumn("seq", F.col("turn") * 1000 + F.col("session_id"))
    stream = as_stream(spark, turns, str(tmp_path / "turns"))
    context = stateful.run_steps(stream, "session_id", ["seq"], "history string", stateful.context_step(2))
    last = collect_stream(context, spark, str(tmp_path / "b")).groupBy("session_id").agg(
        F.max_by("history", "seq").alias("h"))
    shown = F.array_join(F.transform(
        F.from_json("h", "array<array<string>>"), lambda m: F.concat(m[0], F.lit(": "), m[1])), "\n")
    assert rows(last.select("session_id", shown.alias("history")), "session_id", "history") == rows(
        retrieval_q.conversation_context(spark, sf), "session_id", "history")


def fold_stream(spark, stream, root, schema, *how, **idle):
    out = run(stream, root, stateful.fold_handler(os.path.join(root, "out"), *how, **idle))
    return read_batches(spark, out, "rows", schema)


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_folded_batches_match_batch(spark, sf, tmp_path, parts):
    records = events.chain_records(events_q.events_view(spark, sf))
    stream = as_stream(spark, records, str(tmp_path / "in"), parts)
    got = fold_stream(spark, stream, str(tmp_path / "a"), "seq bigint, event_type string, met boolean",
                      "student_id", ["seq"], "met boolean", stateful.chain_step)
    assert got.count() == records.count()
    assert rows(got.filter("event_type = 'student.checkin.completed'"), "seq", "met") == rows(
        events_q.completion_prereq(spark, sf), "seq", "prerequisites_met")

    requests = access_q._requests(spark, sf).withColumn("ms", epoch_millis("ts")).withColumn("n", F.lit(1).cast("bigint"))
    stream = as_stream(spark, requests, str(tmp_path / "requests"), parts)
    outputs = "outcome string, errors bigint, lock_minutes bigint"
    locks = fold_stream(spark, stream, str(tmp_path / "b"), "seq bigint, " + outputs, "phone", ["ms", "seq"], outputs,
                        limits.lockout_step(access_q.MAX_ERRORS, access_q.LOCK_SECONDS * 1000))
    assert rows(locks, "seq", "outcome", "errors") == rows(access_q.lockout(spark, sf), "seq", "outcome", "errors")


def test_folded_batches_keep_null_keys_and_forget_idle_ones(spark, tmp_path):
    given = spark.createDataFrame(
        [(0, 0, None, "user", "a"), (1, 5, "s", "user", "b"), (2, 9, None, "user", "c"), (3, 30, "s", "user", "d"),
         (4, 2**60, "s", None, None), (5, 2**60 + 1, "s", "user", "e")],
        "seq bigint, ms bigint, session_id string, role string, content string")
    stream = as_stream(spark, given, str(tmp_path / "in"), 3)
    got = fold_stream(spark, stream, str(tmp_path / "a"), "seq bigint, ms bigint, history string",
                      "session_id", ["seq"], "history string", stateful.context_step(2), time="ms", idle_ms=20)
    assert [(r.seq, r.ms, len(json.loads(r.history))) for r in got.orderBy("seq").collect()] == [
        (0, 0, 1), (1, 5, 1), (2, 9, 2), (3, 30, 1), (4, 2**60, 1), (5, 2**60 + 1, 2)]


def test_a_batch_of_one_key_is_folded_in_little_memory(spark, tmp_path):
    def step(state, row):
        count = (state or 0) + 1
        return count, (count, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)

    given = spark.range(1_000_000).select(F.col("id").alias("seq"), F.lit("k").alias("k"), F.rpad(
        F.col("id").cast("string"), 400, "x").alias("text"))
    stream = as_stream(spark, given, str(tmp_path / "in"), 2)
    got = fold_stream(spark, stream, str(tmp_path / "a"), "seq bigint, n bigint, kb bigint", "k", ["seq"], "n bigint, kb bigint", step)
    assert got.filter("n <> seq + 1").count() == 0 and got.count() == 1_000_000
    grown = got.groupBy("batch_id").agg((F.max("kb") - F.min("kb")).alias("kb")).collect()
    assert len(grown) == 2 and max(r.kb for r in grown) < 100_000


def test_idle_state_is_forgotten(spark, tmp_path):
    turns = spark.createDataFrame([(i, 1, "user", f"m{i}") for i in range(2)], "seq bigint, session_id bigint, role string, content string")
    stream = as_stream(spark, turns, str(tmp_path / "in"), parts=2)
    said = stateful.run_steps(stream, "session_id", ["seq"], "history string", stateful.context_step(2), idle_ms=1000)
    out = str(tmp_path / "rows")
    query = said.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="8 seconds").start()
    query.awaitTermination(40)
    query.stop()
    assert [r.history for r in spark.read.parquet(out).orderBy("seq").collect()] == ['[["user", "m0"]]', '[["user", "m1"]]']


def test_change_log_parser_works_on_a_stream(spark, sf, tmp_path):
    raw = changes_q._json_log(spark, sf)
    stream = as_stream(spark, raw, str(tmp_path / "in"))
    got = collect_stream(src.parse_changes(stream), spark, str(tmp_path))
    assert rows(got, "seq", "operation", "parse_error") == rows(
        changes_q.cdc_parse(spark, sf), "seq", "operation", "parse_error")


@pytest.mark.parametrize("parts", [1, 4])
def test_latency_stream_matches_batch(spark, sf, tmp_path, parts):
    samples = changes_q.change_log(spark, sf).select("source_server", "seq", "latency_ms")
    root = str(tmp_path / "job")
    handler = together(latency_handler(os.path.join(root, "out"), size=100))
    out = run(as_stream(spark, samples, str(tmp_path / "in"), parts), root, handler)
    newest = monitor.latest_samples(samples, "source_server", "seq", 100)
    want = monitor.latency_percentiles(newest, "source_server", "seq", "latency_ms")
    columns = ["source_server", "samples", "p95_ms", "p99_ms", "healthy"]
    streamed = read_batches(spark, out, "latency", "source_server string, samples bigint, p95_ms bigint, p99_ms bigint, healthy boolean")
    last = streamed.filter(F.col("batch_id") == streamed.agg(F.max("batch_id")).first()[0])
    assert rows(last, *columns) == rows(want, *columns)
    sketches = read_batches(spark, out, "latency_sketches", "source_server string, sketch binary")
    every = {}
    for r in samples.collect():
        every.setdefault(r.source_server, []).append(r.latency_ms)
    for r in running_latency(sketches).collect():
        values = every[r.source_server]
        assert r.samples == len(values)
        for percent, got in ((50, r.p50_ms), (95, r.p95_ms), (99, r.p99_ms)):
            rank = sum(v <= got for v in values) / len(values)
            assert abs(rank - percent / 100) < 0.03


@pytest.mark.parametrize("parts", [1, 5])
def test_arrivals_stream_matches_batch_and_keeps_late_rows(spark, sf, tmp_path, parts):
    view = events_q.events_view(spark, sf).select("seq", "event_type", "ts")
    # Half a day back for some, so that their hours have been given out when they come.
    back = F.when(F.col("seq") % 17 == 0, F.expr("interval 12 hours")).otherwise(F.expr("interval 0 hours"))
    view = view.withColumn("ts", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("seq") * 300_000).cast("timestamp_ntz") - back)
    root = str(tmp_path / "job")
    out = run(as_stream(spark, view, str(tmp_path / "in"), parts), root, arrivals_handler(os.path.join(root, "out")))
    closed = read_batches(spark, out, "hours", HOURS_SCHEMA)
    open_hours = read_batches(spark, out, "open_hours", HOURS_SCHEMA)
    last = open_hours.filter(F.col("batch_id") == read_batches(spark, out, "watermark", "latest timestamp_ntz").agg(F.max("batch_id")).first()[0])
    late = read_batches(spark, out, "late", "seq bigint, ts timestamp_ntz, hour timestamp_ntz")
    assert closed.count() == closed.select("hour").distinct().count()
    every = closed.drop("batch_id").unionByName(last.drop("batch_id")).unionByName(
        late.groupBy("hour").agg(F.count(F.lit(1)).alias("arrivals"))).groupBy("hour").agg(F.sum("arrivals").alias("arrivals"))
    assert rows(every, "hour", "arrivals") == rows(progress.hourly_arrivals(view), "hour", "arrivals")
    assert (late.count() > 0) == (parts > 1) and closed.count() > 0


def test_merged_progress_reads_few_folders_and_survives_a_replay(spark, sf, tmp_path):
    view = events_q.events_view(spark, sf)
    root, calls = str(tmp_path / "job"), []
    handler = merged_progress_handler(os.path.join(root, "out"))

    def failing(batch, batch_id):
        calls.append(batch_id)
        yield from handler(batch, batch_id)
        if batch_id == 5 and calls.count(5) == 1:
            raise RuntimeError("lost after the write")

    stream = as_stream(spark, view, str(tmp_path / "in"), parts=11)
    try:
        run(stream, root, failing)
    except Exception:  # the first run stops after it has written its sixth batch
        pass
    out = run(stream, root, failing)
    assert calls.count(5) == 2 and max(calls) == 10
    state = current_steps(read_merged(spark, out, "steps", STEP_SCHEMA, 10))
    assert rows(state, "student_id", "step_code", "completed_at") == rows(
        progress.latest_steps(view), "student_id", "step_code", "completed_at")
    assert read_merged(spark, out, "steps", STEP_SCHEMA, -1).count() == 0


def test_merged_runs_cover_every_batch_once():
    held = {}
    for batch in range(130):
        kept = set(_runs(batch + 1))
        held[batch] = {batch}.union(*[held[b] for b in _runs(batch) if b not in kept])
        cover = [x for b in kept for x in held[b]]
        assert sorted(cover) == list(range(batch + 1)) and len(kept) <= 8


def test_observed_counters_come_with_the_write(spark, sf):
    handled, counters = monitor.observed(changes_q.handled(spark, sf))
    handled.write.format("noop").mode("overwrite").save()
    totals = changes_q.cdc_stats(spark, sf).agg(*[F.sum(c).alias(c) for c in (
        "total_events", "success_count", "failure_count", "dead_letter_count", "skipped_count")]).first()
    assert counters.get == totals.asDict()
