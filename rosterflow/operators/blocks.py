"""Running values over an ordered key without putting the whole key in one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one
task, which fails when one key holds a third of the data.  The helpers here cut
each key into ordered blocks, compute the running value inside each block, and
add what came before the block from a one-row-per-block summary.  A block holds
at most as many rows as its width, so every window is bounded by construction.

``block`` must not decrease along ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rosterflow.operators.joins import join_back

BLOCK_ROWS = 1_000_000
BLOCK_MILLIS = 3_600_000

_BLK, _IN, _SUM, _PRE = "__blk", "__in", "__sum", "__pre"


def by_sequence(seq: str, width: int = BLOCK_ROWS) -> Column:
    """Block of a unique arrival number: at most ``width`` rows."""
    return F.floor(F.col(seq) / F.lit(width)).cast("bigint")


def by_millis(ms: str, width: int = BLOCK_MILLIS) -> Column:
    """Block of an epoch-millisecond column: at most ``width`` distinct values."""
    return F.floor(F.col(ms) / F.lit(width)).cast("bigint")


def _blocks_before(summary: DataFrame, keys: Sequence[str], agg: Column) -> DataFrame:
    before = W.partitionBy(*keys).orderBy(_BLK).rowsBetween(W.unboundedPreceding, -1)
    return summary.select(*keys, _BLK, agg.over(before).alias(_PRE))


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, block: Column, name: str,
    *, include_current: bool = False,
) -> DataFrame:
    """Largest ``value`` among the earlier rows of the key (nulls are skipped)."""
    blocked = df.withColumn(_BLK, block).withColumn(_SUM, value)
    frame = W.partitionBy(*keys, _BLK).orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if include_current else -1)
    inside = blocked.withColumn(_IN, F.max(_SUM).over(frame))
    summary = blocked.groupBy(*keys, _BLK).agg(F.max(_SUM).alias(_SUM))
    before = _blocks_before(summary, keys, F.max(_SUM))
    return (
        join_back(inside, before, [*keys, _BLK])
        .withColumn(name, F.greatest(F.col(_IN), F.col(_PRE)))
        .drop(_BLK, _IN, _SUM, _PRE)
    )


def running_count(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, name: str,
    *, descending: bool = False,
) -> DataFrame:
    """1-based position of each row of the key along ``order``.

    With ``descending`` the order columns must sort downwards and ``block`` must
    not increase along them.
    """
    blocked = df.withColumn(_BLK, -block if descending else block)
    inside = blocked.withColumn(_IN, F.row_number().over(W.partitionBy(*keys, _BLK).orderBy(*order)))
    summary = blocked.groupBy(*keys, _BLK).agg(F.count(F.lit(1)).alias(_SUM))
    before = _blocks_before(summary, keys, F.sum(_SUM))
    return (
        join_back(inside, before, [*keys, _BLK])
        .withColumn(name, F.col(_IN).cast("bigint") + F.coalesce(F.col(_PRE), F.lit(0)))
        .drop(_BLK, _IN, _PRE)
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], block: Column,
) -> DataFrame:
    """Values of the row just before: ``values`` maps new column -> source column."""
    blocked = df.withColumn(_BLK, block).withColumn(_SUM, F.struct(*values.values()))
    inside = blocked.withColumn(_IN, F.lag(_SUM).over(W.partitionBy(*keys, _BLK).orderBy(*order)))
    summary = blocked.groupBy(*keys, _BLK).agg(F.max_by(_SUM, F.struct(*order)).alias(_SUM))
    last = summary.select(
        *keys, _BLK, F.lag(_SUM).over(W.partitionBy(*keys).orderBy(_BLK)).alias(_PRE))
    found = F.coalesce(F.col(_IN), F.col(_PRE))
    return (
        join_back(inside, last, [*keys, _BLK])
        .select(*df.columns, *[found[src].alias(new) for new, src in values.items()])
    )
