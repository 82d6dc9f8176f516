"""Change-data-capture operators: images, ids, offsets, enrichment, routing, outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.functions.times import instant_text
from rosterflow.operators import blocks
from rosterflow.operators.joins import first_positions, join_back, keep_last, lookup
from rosterflow.session import written


def effective_image() -> Column:
    """Row state after the change, or before it when there is none after."""
    return F.coalesce(F.col("after"), F.col("before"))


def with_image_checks(changes: DataFrame) -> DataFrame:
    """Effective image plus ``image_ok``: a delete has only a before image, the rest have an after image."""
    is_delete = F.col("operation") == C.OP_DELETE
    image_ok = F.when(
        is_delete, F.col("after").isNull() & F.col("before").isNotNull()
    ).otherwise(F.col("after").isNotNull())
    return changes.withColumns({
        "image": effective_image(),
        "image_ok": F.coalesce(image_ok, F.lit(False)),
    })


def event_id() -> Column:
    """Id from the log position, else from the transaction, else from the time, else from the row's images.

    Changes without any of the first three that carry different rows stay different changes.
    """
    table, op = F.col("source_table"), F.col("operation")
    images = F.md5(F.to_json(F.struct("before", "after")))
    at = F.coalesce(instant_text(F.col("ts")), F.concat(F.lit("row-"), images))
    offset = F.col("source_offset")
    return (
        F.when(
            offset["binlog_file"].isNotNull(),
            F.concat_ws(":", offset["binlog_file"], offset["binlog_position"].cast("string"), table, op))
        .when(F.col("transaction_id").isNotNull(), F.concat_ws(":", F.col("transaction_id"), table, op))
        .otherwise(F.concat_ws(":", table, op, at))
    )


def after_offset(changes: DataFrame, binlog_file: str, position: int) -> DataFrame:
    """Changes not yet covered by a committed offset; a change without offset passes."""
    committed = F.struct(F.lit(binlog_file).alias("binlog_file"),
                         F.lit(position).cast("bigint").alias("binlog_position"))
    return changes.filter(F.col("source_offset").isNull() | (F.col("source_offset") > committed))


def latest_mapping(versions: DataFrame) -> DataFrame:
    """Latest (student_id, id_card, card_id) per student by arrival; none where the latest version is not ``active``."""
    return keep_last(versions, ["student_id"], "seq").filter("active").drop("seq", "active")


def translate_ids(requests: DataFrame, mapping: DataFrame) -> DataFrame:
    """Student -> id card, id card -> student and card -> student in one equi-join.

    ``requests`` has ``kind`` and ``value``; only the latest mapping is searched.
    """
    pairs = F.array(
        F.struct(F.lit("student_id").alias("kind"), F.col("student_id").alias("value"),
                 F.col("id_card").alias("result")),
        F.struct(F.lit("id_card").alias("kind"), F.col("id_card").alias("value"),
                 F.col("student_id").alias("result")),
        F.struct(F.lit("card_id").alias("kind"), F.col("card_id").alias("value"),
                 F.col("student_id").alias("result")),
    )
    index = mapping.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull())
    return requests.join(index, ["kind", "value"], "left")


def enrich(changes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds id_card and card_id by the student id of the image.

    ``mapping_missing`` is set when a student id is present but unmapped; rows
    without a student id pass through.
    """
    keyed = mapping.select(
        "student_id", F.col("id_card").alias("mapped_id_card"),
        F.col("card_id").alias("mapped_card_id"), F.lit(True).alias("__known"))
    probed = changes.withColumn("__sid", effective_image()["student_id"])
    return _enriched(lookup(probed, keyed.withColumnRenamed("student_id", "__sid"), "__sid", ["event_id"]))


def enrich_as_of(changes: DataFrame, versions: DataFrame, block_ms: int = blocks.BLOCK_MILLIS) -> DataFrame:
    """:func:`enrich` with the mapping as it was when the change was made.

    ``versions`` carries student_id, id_card, card_id, active, seq and ts.  The last version at or before the ``ts`` of a
    change holds; of several at one time that with the larger ``seq``.  A change before the first version, or after one
    that is not ``active``, is unmapped; so is a change without a time.  Versions and changes of a student are one ordered
    stream, cut into blocks of time, so that a student with many changes is spread over tasks.
    """
    probed = changes.withColumn("__sid", effective_image()["student_id"])
    facts = F.struct(*[F.col(c).alias(c) for c in ("id_card", "card_id", "active")])
    given = versions.filter("student_id is not null and ts is not null").select(
        F.col("student_id").alias("__sid"), F.unix_millis(F.col("ts").cast("timestamp")).alias("__ms"), F.lit(0).alias("__late"),
        F.col("seq").alias("__at"), F.struct(F.col("ts"), F.col("seq"), facts.alias("m")).alias("__version"))
    asked = probed.filter("__sid is not null and ts is not null").select(
        "__sid", F.unix_millis(F.col("ts").cast("timestamp")).alias("__ms"), F.lit(1).alias("__late"), F.col("seq").alias("__at"),
        F.lit(None).cast(given.schema["__version"].dataType).alias("__version"), "source_server")
    both = given.unionByName(asked, allowMissingColumns=True)
    # Versions rise along the order, so the largest so far is the last one.
    known = blocks.running_max(
        both, ["__sid"], ["__ms", "__late", "__at"], F.col("__version"), blocks.by_millis("__ms", block_ms), "__last")
    mapped = known.filter(F.col("__late") == 1).select(
        "source_server", F.col("__at").alias("seq"), F.col("__last.m.id_card").alias("mapped_id_card"),
        F.col("__last.m.card_id").alias("mapped_card_id"), F.lit(True).alias("__known"), F.col("__last.m.active").alias("__active"))
    mapped = mapped.filter("__active").drop("__active")
    return _enriched(join_back(probed, mapped, ["source_server", "seq"]))


def _enriched(joined: DataFrame) -> DataFrame:
    found = F.map_filter(
        F.create_map(F.lit("id_card"), F.col("mapped_id_card"), F.lit("card_id"), F.col("mapped_card_id")),
        lambda _, v: v.isNotNull())
    own = F.map_filter(effective_image(), lambda k, _: ~F.map_contains_key(found, k))
    missing = F.col("__sid").isNotNull() & F.col("__known").isNull()
    return (
        joined.withColumn("mapping_missing", missing)
        .withColumn("student_id", F.col("__sid"))
        .withColumn(
            "record",
            F.when(missing, F.lit(None).cast("map<string,string>")).otherwise(
                F.coalesce(F.map_concat(own, found), F.create_map().cast("map<string,string>"))))
        .drop("__sid", "__known", "mapped_id_card", "mapped_card_id")
    )


def target_system() -> Column:
    """Target by table prefix; null for a change without a table name."""
    table = F.col("source_table")
    target = F.when(F.coalesce(table, F.lit("")) == "", F.lit(None).cast("string"))
    for prefix, system in C.SINK_BY_TABLE_PREFIX.items():
        target = target.when(table.startswith(prefix), F.lit(system))
    return target.otherwise(F.lit(C.DEFAULT_SINK))


def write_outcome() -> Column:
    """Outcome of a change once it reaches its target: missing mapping before routing before the write."""
    return (
        F.when(F.col("mapping_missing"), F.lit(C.MAPPING_MISSING))
        .when(F.col("target").isNull(), F.lit(C.DEAD_LETTER))
        .when(F.col("sink_result") == C.SUCCESS, F.lit(C.SUCCESS))
        .when(F.col("sink_result") == C.DEAD_LETTER, F.lit(C.DEAD_LETTER))
        .otherwise(F.lit(C.RETRY_EXHAUSTED))
    )


def write_attempts(changes: DataFrame, results: str = "results") -> DataFrame:
    """One row for each write of a change: ``attempt`` from 0, its ``result``, ``due_at``, and whether it is the ``last``.

    ``results`` holds what the target answers in turn; the last answer repeats.  Anything but SUCCESS and DEAD_LETTER is
    tried again, three times at most, after the delays of the ladder.  Without any answer the result is RETRY.
    """
    most = 1 + C.MAX_RETRY_COUNT
    given = F.filter(F.coalesce(results, F.array()), lambda r: r.isNotNull())
    given = F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(C.RETRY)))
    padded = F.slice(F.concat(given, F.array_repeat(F.element_at(given, -1), most)), 1, most)
    ends = F.array_position(F.transform(padded, lambda r: r.isin(C.SUCCESS, C.DEAD_LETTER)), True)
    used = F.when(ends > 0, ends).otherwise(F.lit(most)).cast("int")
    tries = changes.withColumn("__used", used).select("*", F.posexplode(F.slice(padded, F.lit(1), used)).alias("attempt", "result"))
    waits = [sum(C.RETRY_DELAYS_SECONDS[:n]) for n in range(most)]
    waited = F.element_at(F.array(*[F.lit(w) for w in waits]), F.col("attempt") + 1)
    return tries.withColumns({
        "due_at": F.col("ts") + F.make_dt_interval(secs=waited),
        "last": F.col("attempt") + 1 == F.col("__used"),
    }).drop("__used", results)


def attempted_outcome() -> Column:
    """Outcome of the last write of a change."""
    result = F.col("result")
    return F.when(result.isin(C.SUCCESS, C.DEAD_LETTER), result).otherwise(F.lit(C.RETRY_EXHAUSTED))


def high_water(
    changes: DataFrame, committed: Column, source: str = "source_server", seq: str = "seq",
    block_rows: int = blocks.BLOCK_ROWS,
) -> DataFrame:
    """Largest offset committed by earlier arrivals of the same source, and whether the row is stale."""
    marked = blocks.running_max(
        changes, [source], [seq], committed, blocks.by_sequence(seq, block_rows), "committed_offset")
    return marked.withColumn(
        "stale", F.coalesce(F.col("source_offset") <= F.col("committed_offset"), F.lit(False)))


def outcomes(
    changes: DataFrame, mapping: DataFrame, source: str = "source_server",
    block_rows: int = blocks.BLOCK_ROWS, store: Callable[[DataFrame, str], DataFrame] = written,
) -> DataFrame:
    """One outcome per delivered change.

    ``changes`` carries ``seq`` (arrival), ``source_server`` and ``sink_result``
    (result of the target after its retries).  A copy of an earlier change and a
    change at or below the committed offset are skipped; only successes move the
    committed offset.  The enriched changes are read three times, so ``store`` keeps
    them: a table in the shared folder, unless a caller has them in hand already.
    """
    identified = changes.withColumns({"event_id": event_id(), "target": target_system()})
    routed = store(enrich(identified, mapping).withColumn("own_outcome", write_outcome()), "routed")
    copies = first_positions(routed, [source, "event_id"], "seq", "first_seq")
    flagged = (
        routed.join(copies, [source, "event_id"], "left")
        .withColumn("is_copy", F.coalesce(F.col("seq") > F.col("first_seq"), F.lit(False)))
    )
    commits = F.when(~F.col("is_copy") & (F.col("own_outcome") == C.SUCCESS), F.col("source_offset"))
    marked = high_water(flagged, commits, source, block_rows=block_rows)
    return marked.withColumn(
        "outcome",
        F.when(F.col("stale") | F.col("is_copy"), F.lit(C.SKIPPED_DUPLICATE)).otherwise(F.col("own_outcome")),
    ).drop("own_outcome", "first_seq", "is_copy", "stale", "committed_offset")


def dead_letter_reason() -> Column:
    return (
        F.when(F.col("outcome") == C.MAPPING_MISSING,
               F.concat(F.lit("MappingMissing: student_id="), F.coalesce("student_id", F.lit("unknown"))))
        .when(F.col("outcome") == C.DEAD_LETTER,
              F.concat(F.lit("SinkDeadLetter: "), F.coalesce("source_table", F.lit(""))))
        .when(F.col("outcome") == C.RETRY_EXHAUSTED,
              F.concat(F.lit("RetryExhausted: table="), F.coalesce("source_table", F.lit(""))))
    )


def dead_letters(handled: DataFrame, compensated: DataFrame | None = None) -> DataFrame:
    """Last entry per event id with its reason, without the compensated ones."""
    failed = handled.withColumn("reason", dead_letter_reason()).filter(F.col("reason").isNotNull())
    entries = keep_last(
        failed.select("source_server", "event_id", "source_table", "reason", "seq"),
        ["source_server", "event_id"], "seq")
    return entries if compensated is None else entries.join(
        compensated, ["source_server", "event_id"], "left_anti")


def sync_stats(handled: DataFrame, by: str = "source_server") -> DataFrame:
    """Counters over outcomes; every dead letter is also a failure."""
    failed = F.col("outcome").isin(C.DEAD_LETTER, C.MAPPING_MISSING, C.RETRY_EXHAUSTED)
    return handled.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("outcome") == C.SUCCESS).alias("success_count"),
        F.count_if(failed).alias("failure_count"),
        F.count_if(failed).alias("dead_letter_count"),
        F.count_if(F.col("outcome") == C.SKIPPED_DUPLICATE).alias("skipped_count"),
    )


def batch_result(handled: DataFrame, tables: tuple[str, ...] = ()) -> DataFrame:
    """Synced and failed rows of a batch run, per table; ``tables`` that were scanned without finding a row have zeros."""
    ok = F.col("outcome") == C.SUCCESS
    found = handled.groupBy("source_table").agg(
        F.count_if(ok).alias("synced"), F.count_if(~ok).alias("failed"))
    if not tables:
        return found
    scanned = handled.sparkSession.createDataFrame([(t,) for t in tables], "source_table string")
    return found.join(scanned, "source_table", "full").select(
        "source_table", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("synced", "failed")])
