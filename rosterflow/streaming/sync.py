"""Continuous change synchronisation with checkpoint and resume."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.operators import blocks
from rosterflow.operators import changes as ops
from rosterflow.operators import monitor
from rosterflow.operators.joins import first_positions
from rosterflow.session import written
from rosterflow.streaming.batches import read_state

Sink = Callable[[DataFrame], DataFrame]

OFFSET = "struct<binlog_file:string,binlog_position:bigint>"
COMMITTED_SCHEMA = f"source_server string, committed {OFFSET}"
LATENCY_SCHEMA = "source_server string, seq bigint, latency_ms bigint"
SEEN_SCHEMA = f"source_server string, event_id string, source_offset {OFFSET}, ts timestamp_ntz"


def _covered(rows: DataFrame, by: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether a row of ``by`` (source_server, seq, source_offset) that came earlier has its offset or a later one."""
    both = rows.select("source_server", "seq", "source_offset", F.lit(False).alias("given")).unionByName(
        by.select("source_server", "seq", "source_offset", F.lit(True).alias("given")))
    reached = blocks.running_max(
        both, ["source_server"], ["seq", "given"], F.when(F.col("given"), F.col("source_offset")), blocks.by_sequence("seq"),
        "reached")
    return rows.join(reached.filter("not given").select("source_server", "seq", F.coalesce(
        F.col("source_offset") <= F.col("reached"), F.lit(False)).alias(name)), ["source_server", "seq"])


def deliver(changes: DataFrame, sink: Sink) -> DataFrame:
    """Hands changes to the sink in the order of the log and adds ``sink_result``; null for those it never gets.

    ``changes`` are first copies with a mapped record and a target.  A change is skipped once an earlier one with its
    offset or a later one has succeeded.  So changes whose offsets rise are handed over at once, and one that lies
    below an earlier offset waits until that one's result is known.
    """
    waiting, done = changes, None
    while not waiting.isEmpty():
        if done is not None:
            waiting = _covered(waiting, done.filter(F.col("sink_result") == C.SUCCESS), "stale")
            skipped = waiting.filter("stale").drop("stale").withColumn("sink_result", F.lit(None).cast("string"))
            waiting = written(waiting.filter("not stale").drop("stale"), "waiting")
            done = written(done.unionByName(skipped), "delivered")
        held = written(_covered(waiting, waiting, "held"), "held")
        results = written(sink(held.filter("not held").drop("held")).select(*changes.columns, "sink_result"), "delivered")
        done = results if done is None else written(done.unionByName(results), "delivered")
        waiting = held.filter("held").drop("held")
    return changes.withColumn("sink_result", F.lit(None).cast("string")) if done is None else done


def sync_handler(mapping: DataFrame, root: str, sink: Sink, horizon_hours: int = C.IDEMPOTENT_HOURS):
    """Handler for :func:`run_batches`: outcomes, target rows, dead letters, offsets and counters.

    A change passes the committed offset, the check for copies, the mapping and the route before ``sink`` gets it, with
    ``target``, ``event_id`` and the mapped ``record``; ``sink`` returns it with ``sink_result``.  Offsets and handled ids
    are state that each batch writes whole, so a restarted job goes on where the last whole batch ended.  Ids are
    remembered until the committed offset covers them or, without an offset, for ``horizon_hours`` of event time.
    """
    def handle(batch: DataFrame, batch_id: int) -> Iterator[tuple]:
        spark = batch.sparkSession
        committed = read_state(spark, root, "committed", COMMITTED_SCHEMA, batch_id)
        seen = read_state(spark, root, "seen", SEEN_SCHEMA, batch_id)
        known = seen.select("source_server", "event_id").distinct().withColumn("seen", F.lit(True))
        identified = batch.withColumns({"event_id": ops.event_id(), "target": ops.target_system()})
        copies = first_positions(identified, ["source_server", "event_id"], "seq", "first_seq")
        old = F.coalesce(F.col("seen"), F.col("seq") > F.col("first_seq"), F.lit(False)) | F.coalesce(
            F.col("source_offset") <= F.col("committed"), F.lit(False))
        marked = (
            ops.enrich(identified, mapping).join(committed, "source_server", "left")
            .join(known, ["source_server", "event_id"], "left").join(copies, ["source_server", "event_id"], "left")
            .withColumn("old", old).drop("seen", "first_seq", "committed"))
        marked = written(marked, "marked")
        routable = ~F.col("old") & ~F.col("mapping_missing") & F.col("target").isNotNull()
        sent = deliver(marked.filter(routable).drop("sink_result"), sink)
        # The offset comes before all other checks, so it also skips what could not have been written.
        handled = _covered(marked.drop("sink_result"), sent.filter(F.col("sink_result") == C.SUCCESS), "stale").join(
            sent.select("source_server", "seq", "sink_result"), ["source_server", "seq"], "left")
        handled = written(handled.withColumn("outcome", F.when(
            F.col("old") | F.col("stale"), F.lit(C.SKIPPED_DUPLICATE)).otherwise(ops.write_outcome())), "handled")
        success = F.col("outcome") == C.SUCCESS
        moved = committed.unionByName(
            handled.filter(success & F.col("source_offset").isNotNull()).select(
                "source_server", F.col("source_offset").alias("committed"))).groupBy("source_server").agg(
            F.max("committed").alias("committed"))
        now = seen.select("ts").union(batch.select("ts")).agg(F.max("ts").alias("now")).select("now").scalar()
        fresh = handled.filter(F.col("outcome") != C.SKIPPED_DUPLICATE).select(
            "source_server", "event_id", "source_offset", "ts")
        open_ids = seen.unionByName(fresh).join(moved, "source_server", "left").filter(
            F.when(F.col("source_offset").isNotNull(), F.coalesce(F.col("source_offset") > F.col("committed"), F.lit(True)))
            .otherwise(F.coalesce(F.col("ts") > now - F.make_dt_interval(hours=F.lit(horizon_hours)), F.lit(True))))
        yield "outcomes", handled.select("seq", "source_server", "event_id", "outcome")
        rows = handled.filter(success).select("target", "event_id", F.to_json("record").alias("record"))
        yield "targets", rows, "target"
        yield "dead_letters", ops.dead_letters(handled)
        yield "committed", moved
        yield "seen", open_ids.select("source_server", "event_id", "source_offset", "ts")
        yield "stats", ops.sync_stats(handled)

    return handle


def running_stats(batches: DataFrame) -> DataFrame:
    """Counters over all batches, from the per-batch counter table."""
    counters = [c for c in batches.columns if c.endswith(("_count", "_events"))]
    return batches.groupBy("source_server").agg(*[F.sum(c).alias(c) for c in counters])


def latency_handler(root: str, size: int = C.LATENCY_WINDOW):
    """Handler for :func:`run_batches` over samples (source_server, seq, latency_ms).

    The newest ``size`` samples of each source are state; ``latency`` holds their percentiles after each batch.  Older
    samples live on in ``latency_sketches``, one small row a source and batch that :func:`running_latency` merges.
    """
    def handle(batch: DataFrame, batch_id: int) -> Iterator[tuple]:
        samples = batch.select("source_server", "seq", F.col("latency_ms").cast("bigint").alias("latency_ms"))
        held = read_state(batch.sparkSession, root, "latency_window", LATENCY_SCHEMA, batch_id)
        window = written(monitor.latest_samples(held.unionByName(samples), "source_server", "seq", size), "window")
        yield "latency_window", window
        yield "latency", monitor.latency_percentiles(window, "source_server", "seq", "latency_ms")
        yield "latency_sketches", samples.groupBy("source_server").agg(
            F.kll_sketch_agg_bigint("latency_ms").alias("sketch"))

    return handle


def together(*handlers):
    """One handler that runs several over the same batches."""
    def handle(batch: DataFrame, batch_id: int) -> Iterator[tuple]:
        for handler in handlers:
            yield from handler(batch, batch_id)

    return handle


def running_latency(sketches: DataFrame, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Latency at each percentile over all batches, within the rank error of the sketches (about 1.3 %)."""
    merged = sketches.groupBy("source_server").agg(F.kll_merge_agg_bigint("sketch").alias("s"))
    return merged.select("source_server", F.kll_sketch_get_n_bigint("s").alias("samples"), *[
        F.kll_sketch_get_quantile_bigint("s", F.lit(p / 100.0)).alias(f"p{p}_ms") for p in percents])
