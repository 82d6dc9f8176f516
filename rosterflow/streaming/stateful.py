"""Keyed state machines on streams, with the same steps as the batch folds."""

from __future__ import annotations

import json
from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from rosterflow import constants as C
from rosterflow.operators.folds import Step, epoch_millis
from rosterflow.operators.joins import join_back
from rosterflow.session import written
from rosterflow.streaming.batches import Handler, merged_handler, read_merged

STATE_SCHEMA = "__group string, __state string, __batch bigint"


def run_steps(
    stream: DataFrame, key: str, order: list[str], outputs: str, step: Callable[[], Step] | Step,
    idle_ms: int | None = None,
) -> DataFrame:
    """Applies ``step(state, row) -> (state, output values)`` per key over micro-batches.

    The result has the columns of the stream and the ``outputs``.  Rows of a key
    are ordered within a micro-batch, whose size the source limits (:func:`fold_handler` needs no limit); the state is
    kept as JSON in the state store, until the key has had no row for ``idle_ms`` of the clock (None: for good).  Spark goes
    on running batches to find idle keys, so with ``idle_ms`` a stream needs a trigger that does not wait for its end.
    """
    names = [part.split()[0] for part in outputs.split(",")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", " + outputs

    def advance(_, frames: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        if store.hasTimedOut:
            store.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order)
        now = store.getCurrentProcessingTimeMs() if idle_ms is not None else 0
        last, state = json.loads(store.get[0]) if store.exists else (now, None)
        # Rows that come before Spark has looked for idle keys find an old state.
        if idle_ms is not None and now - last >= idle_ms:
            state = None
        results = []
        for row in rows.itertuples(index=False):
            state, result = step(state, row)
            results.append(result)
        store.update((json.dumps([now, state]),))
        if idle_ms is not None:
            store.setTimeoutDuration(idle_ms)
        for position, name in enumerate(names):
            rows[name] = [r[position] for r in results]
        yield rows

    return stream.groupBy(key).applyInPandasWithState(
        advance, schema, "state string", "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest_states(states: DataFrame) -> DataFrame:
    """The last state of each key among those that several batches left."""
    return states.groupBy("__group").agg(F.max_by("__state", "__batch").alias("__state"), F.max("__batch").alias("__batch"))


def fold_handler(
    root: str, key: str, order: list[str], outputs: str, step: Step, time: str | None = None, idle_ms: int | None = None,
) -> Handler:
    """Handler for :func:`run_batches`: ``step`` along the rows of each key, however many a batch holds.

    Yields "rows", the rows of the batch with the ``outputs``, and "state", the states after it in merged runs, where only
    keys of the batch are written anew.  Spark sorts the rows of a key and they pass through the task in Arrow batches, so
    memory holds one of these and one state.  A key forgets its state where ``time`` (milliseconds) is ``idle_ms`` or more
    after that of its row before; as this follows the rows and not the clock, a replayed batch gives the same.
    """
    added = StructType.fromDDL(outputs)
    merge = merged_handler(root, "state", STATE_SCHEMA, lambda rows: rows, latest_states)

    def handle(batch: DataFrame, batch_id: int) -> Iterator[tuple]:
        names = batch.columns
        place = names.index(time) if time else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row_of = namedtuple("row_of", names, rename=True)
            owner, last, state, ends, shape = None, None, None, [], None

            def left() -> pa.RecordBatch:
                columns = [pa.nulls(len(ends), t) for t in shape.types]
                columns += [pa.array(c, pa.string()) for c in zip(*ends)]
                ends.clear()
                return pa.record_batch(columns, names=[*shape.names, "__group", "__state"])

            for rows in batches:
                results = []
                values = zip(*(rows.column(n).to_pylist() for n in names))
                for group, start, row in zip(rows.column("__group").to_pylist(), rows.column("__start").to_pylist(), values):
                    if group != owner:
                        if owner is not None:
                            ends.append((owner, json.dumps([last, state])))
                        owner = group
                        last, state = json.loads(start) if start else (None, None)
                    if idle_ms is not None:
                        if last is not None and row[place] - last >= idle_ms:
                            state = None
                        last = row[place]
                    state, result = step(state, row_of(*row))
                    results.append(result)
                shape = pa.schema([rows.schema.field(n) for n in names] + [
                    pa.field(f.name, to_arrow_type(f.dataType)) for f in added.fields])
                columns = [rows.column(n) for n in names]
                columns += [pa.array([r[i] for r in results], to_arrow_type(f.dataType)) for i, f in enumerate(added.fields)]
                none = pa.nulls(len(results), pa.string())
                yield pa.record_batch([*columns, none, none], names=[*shape.names, "__group", "__state"])
                if ends:
                    yield left()
            if owner is not None:
                ends.append((owner, json.dumps([last, state])))
                yield left()

        grouped = batch.withColumn("__group", F.to_json(F.struct(key), {"ignoreNullFields": "false"}))
        known = latest_states(read_merged(batch.sparkSession, root, "state", STATE_SCHEMA, batch_id - 1))
        # The state goes with the first row of its key alone, so a large one is not copied to every row.
        firsts = grouped.groupBy("__group").agg(F.min(F.struct(*order)).alias("first"))
        starts = firsts.join(known, "__group").select("__group", "first.*", F.col("__state").alias("__start"))
        started = join_back(grouped, starts, ["__group", *order])
        arranged = started.repartition("__group").sortWithinPartitions("__group", *order)
        schema = StructType(batch.schema.fields + added.fields).add("__group", "string").add("__state", "string")
        folded = written(arranged.mapInArrow(run, schema), "fold")
        yield "rows", folded.filter("__state is null").drop("__group", "__state")
        states = folded.filter("__state is not null").select("__group", "__state", F.lit(batch_id).cast("bigint").alias("__batch"))
        yield from merge(states, batch_id)

    return handle


def limit_stream(requests: DataFrame, key: str, outputs: str, step: Step, ts: str = "ts") -> DataFrame:
    """A limiter of :mod:`rosterflow.operators.limits` over single requests."""
    timed = requests.withColumn("ms", epoch_millis(ts)).withColumn("n", F.lit(1).cast("bigint"))
    return run_steps(timed, key, ["ms", "seq"], outputs, step)


def context_step(rounds: int = C.HISTORY_ROUNDS) -> Step:
    """Keeps the last rounds of a session; emits the history after each message.  A message of role "clear" forgets it."""
    def step(state, row):
        if row.role == "clear":
            return [], ("[]",)
        history = ((state or []) + [[row.role, row.content]])[-2 * rounds:]
        return history, (json.dumps(history, ensure_ascii=False),)
    return step


def chain_step(state, row):
    """Remembers the event types of a student; emits whether completion may be accepted."""
    seen = state or []
    needed = {C.CHECKIN_SUCCESS, C.PAYMENT_COMPLETED, C.VERIFIED_SUCCESS}
    met = needed <= set(seen)
    return sorted(set(seen) | {row.event_type}), (met,)
