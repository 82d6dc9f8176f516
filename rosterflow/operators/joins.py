"""Lookups against keyed tables.

Only fixed tables are broadcast by hint.  Every other lookup is a plain
equi-join: Spark broadcasts the keyed side when its *measured* size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where AQE
splits partitions that one hot key has filled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = "__lookup_key"


def lookup(left: DataFrame, keyed: DataFrame, key: str, spread: Sequence[str]) -> DataFrame:
    """Left join to at most one row per ``key``.

    Rows without a key can match nothing; they get a filler key made from the
    ``spread`` columns, so that a third of the table being null does not land in
    one task.
    """
    filler = F.concat(F.lit("\u0000"), F.xxhash64(*spread).cast("string"))
    probe = left.withColumn(_KEY, F.coalesce(F.col(key).cast("string"), filler))
    side = keyed.withColumnRenamed(key, _KEY).withColumn(_KEY, F.col(_KEY).cast("string"))
    return probe.join(side, _KEY, "left").drop(_KEY)


def join_back(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on columns of both sides in which null equals null; the keys come out once."""
    renamed = {key: f"__back_{key}" for key in keys}
    condition = None
    for key, name in renamed.items():
        same = F.col(key).eqNullSafe(F.col(name))
        condition = same if condition is None else condition & same
    return left.join(right.withColumnsRenamed(renamed), condition, how).drop(*renamed.values())


def fixed_table(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A broadcastable table of fixed values from :mod:`rosterflow.constants`."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def keep_first(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """First row per key by arrival.

    An aggregate rather than a window: copies of one key are combined before the
    shuffle, however many there are.
    """
    return _keep(df, keys, F.min_by, seq)


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last row per key by arrival."""
    return _keep(df, keys, F.max_by, seq)


def _keep(df, keys, pick, seq):
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(seq)).alias("__row"))
    return kept.select(*keys, "__row.*").select(*df.columns)


def first_positions(df: DataFrame, keys: Sequence[str], seq: str, name: str) -> DataFrame:
    """Arrival number of the first copy, for keys that occur more than once."""
    return (
        df.groupBy(*keys)
        .agg(F.min(seq).alias(name), F.count(F.lit(1)).alias("__copies"))
        .filter("__copies > 1")
        .drop("__copies")
    )
