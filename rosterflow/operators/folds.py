"""Order-dependent state machines over keys, run in parallel.

Limiters and lockouts need the state left by the row before, so they are no
window functions.  A key is cut at the points where its state is known anyway
(an idle gap that refills a bucket, empties a log or ends a window, or a load so
light that nothing can have been refused); the pieces are independent and spread
over the cluster.  Within a piece, rows stream through the task in sorted Arrow
batches and only the small state is kept: no group is collected.  Requests of one
key in the same millisecond are counted before the shuffle, so a piece has at
most one row per millisecond of unbroken activity, however many requests there
are.  Where a machine has few states, blocks of one piece run side by side too
(:func:`fold_blocks`).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterflow.operators import blocks
from rosterflow.operators.joins import join_back
from rosterflow.session import written

# Rows of a block that runs beside others, on average; groups of fewer than so many
# blocks are folded at once.
FOLD_ROWS = 50_000
FOLD_BLOCKS = 4

Step = Callable[[object, tuple], "tuple[object, tuple]"]


def epoch_millis(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def cut_at_gaps(
    counted: DataFrame, key: str, gap_ms: int, block_ms: int, settled: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Adds ``piece``: first millisecond of the stretch without an idle gap of ``gap_ms``.

    ``counted`` has one row (key, ms, n) per millisecond, so a block holds at
    most ``block_ms`` rows; stretches over several blocks are tied together from
    one summary row per block.  ``settled`` adds a column of that name to rows with
    their ``blk``: true where a fold may start anew without any gap.
    """
    inside = W.partitionBy(key, "blk").orderBy("ms")
    along = W.partitionBy(key).orderBy("blk")
    ms = F.col("ms")
    blocked = counted.withColumn("blk", blocks.by_millis("ms", block_ms))
    blocked = settled(blocked) if settled else blocked.withColumn("settled", F.lit(False))
    marked = (
        blocked.withColumn("cut", F.when((ms - F.lag("ms").over(inside) >= gap_ms) | F.col("settled"), ms))
        .withColumn("last_cut", F.max("cut").over(inside)).drop("settled")
    )
    summary = marked.groupBy(key, "blk").agg(
        F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.max("cut").alias("cut"))
    idle = F.col("first_ms") - F.lag("last_ms").over(along)
    tied = summary.withColumn(
        "first_cut", F.when(F.coalesce(idle >= gap_ms, F.lit(True)), F.col("first_ms"))
    ).select(
        key, "blk", "first_cut",
        F.max(F.greatest("cut", "first_cut")).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    return join_back(marked, tied, [key, "blk"]).withColumn(
        "piece", F.greatest("last_cut", "first_cut", "carried")).drop("blk", "cut", "last_cut", "first_cut", "carried")


def cut_after(rows: DataFrame, key: str, order: list[str], known: Column, block_ms: int) -> DataFrame:
    """Adds ``piece``: order of the latest row that follows a row with ``known`` state.

    ``known`` may use ``prev_ms``, the time of the row before within the block.
    Cuts are optional, so rows at the start of a block simply make none.
    """
    inside = W.partitionBy(key, "__b").orderBy(*order)
    blocked = rows.withColumn("__b", blocks.by_millis("ms", block_ms))
    marked = blocked.withColumn("prev_ms", F.lag("ms").over(inside)).withColumn(
        "starts", F.coalesce(F.lag(known).over(inside), F.lit(False)))
    return blocks.running_max(
        marked, [key], order, F.when(F.col("starts"), F.struct(*order)), blocks.by_millis("ms", block_ms),
        "piece", include_current=True).drop("__b", "prev_ms", "starts")


def fold(
    rows: DataFrame, group: list[str], order: list[str], inputs: list[str], outputs: str, step: Step,
    start: str | None = None,
) -> DataFrame:
    """Runs ``step(state, input values) -> (state, output values)`` along each group.

    The result has the columns of ``rows`` and the ``outputs`` ("name type, ...").
    The state starts as None, or as what the column ``start`` holds as JSON.
    """
    names = [part.split()[0] for part in outputs.split(",")]
    fields = [f for f in rows.schema.fields if f.name != start]
    kept = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + outputs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            results = []
            begun = batch[start] if start else [None] * len(batch)
            for owner, first, values in zip(batch["__group"], begun, batch[inputs].itertuples(index=False)):
                if owner != current:
                    current, state = owner, json.loads(first) if first else None
                state, result = step(state, values)
                results.append(result)
            out = batch[kept].copy()
            for position, name in enumerate(names):
                out[name] = [r[position] for r in results]
            yield out

    grouped = rows.withColumn("__group", F.to_json(F.struct(*group), {"ignoreNullFields": "false"}))
    arranged = grouped.repartition("__group").sortWithinPartitions("__group", *order)
    return arranged.mapInPandas(run, schema)


def fold_blocks(
    rows: DataFrame, group: list[str], order: list[str], inputs: list[str], outputs: str, step: Step,
    table: Callable[[pd.DataFrame], dict], hop: Callable[[object, dict], object], block_ms: int,
) -> DataFrame:
    """:func:`fold` with blocks of one group side by side, for machines whose blocks have a small table of exits.

    ``table(rows)`` sums up what a block makes of any state in which it may be entered; ``hop(state, table)`` is the
    state behind it (state None: the group starts).  A walk over one row per block finds the state before each
    block, from which its rows are folded.  Small groups are folded at once, as a block costs more than its rows then.
    """
    spread = written(rows.withColumn("__owner", F.to_json(F.struct(*group), {"ignoreNullFields": "false"})), "fold")
    many = spread.groupBy("__owner").agg(F.min("ms").alias("__low"), F.max("ms").alias("b"), F.count(F.lit(1)).alias("n"))
    many = many.filter(F.col("n") >= FOLD_ROWS * FOLD_BLOCKS)
    width = F.greatest(F.lit(block_ms), F.ceil((F.col("b") - F.col("__low") + 1) / F.ceil(F.col("n") / FOLD_ROWS)))
    long = written(many.select("__owner", "__low", width.cast("bigint").alias("__width")), "long")
    if long.isEmpty():
        return fold(spread.drop("__owner"), group, order, inputs, outputs, step)
    spread = spread.join(long, "__owner", "left").withColumn(
        "__blk", F.floor((F.col("ms") - F.col("__low")) / F.col("__width")).cast("bigint"))

    def summed(block: pd.DataFrame) -> pd.DataFrame:
        first = block.iloc[0]
        exits = table(block.sort_values(order))
        return pd.DataFrame({"__owner": [first["__owner"]], "__blk": [first["__blk"]], "exits": [json.dumps(exits)]})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, state = None, None
        for batch in batches:
            starts = []
            for own, exits in zip(batch["__owner"], batch["exits"]):
                if own != owner:
                    owner, state = own, None
                starts.append(None if state is None else json.dumps(state))
                state = hop(state, json.loads(exits))
            yield pd.DataFrame({"__owner": batch["__owner"], "__blk": batch["__blk"], "__start": pd.Series(starts, dtype=object)})

    needed = ["__owner", "__blk", *dict.fromkeys([*order, *inputs])]
    tables = spread.filter("__blk is not null").select(*needed).groupBy("__owner", "__blk").applyInPandas(
        summed, "__owner string, __blk bigint, exits string")
    starts = tables.repartition("__owner").sortWithinPartitions("__owner", "__blk").mapInPandas(
        walk, "__owner string, __blk bigint, __start string")
    started = join_back(spread.drop("__low", "__width"), starts, ["__owner", "__blk"])
    return fold(started, ["__owner", "__blk"], order, inputs, outputs, step, "__start").drop("__owner", "__blk")


def follow(next_row: np.ndarray) -> np.ndarray:
    """Last row of the chain from each row; ``next_row`` is later than the row, or the number of rows where it ends."""
    rows = np.arange(len(next_row))
    jump = np.where(next_row < len(next_row), np.minimum(next_row, len(next_row) - 1), rows)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further
