"""Micro-batch jobs: one handler call per batch, idempotent output per batch."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Handler = Callable[[DataFrame, int], "Iterator[tuple]"]


def batch_path(root: str, table: str, batch_id: int) -> str:
    return os.path.join(root, table, f"batch_id={batch_id}")


def run_batches(stream: DataFrame, handler: Handler, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes what ``handler`` yields per batch to ``<root>/<table>/batch_id=<n>``.

    It yields (table, rows), optionally followed by partition columns.
    A batch that is replayed after a failure overwrites its own folder, so the
    output holds every batch exactly once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            for table, rows, *by in handler(held, batch_id):
                rows.write.mode("overwrite").partitionBy(*by).parquet(batch_path(root, table, batch_id))
        finally:
            held.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_state(spark: SparkSession, root: str, table: str, schema: str, batch_id: int) -> DataFrame:
    """What the batch before ``batch_id`` left in ``table``, which every batch writes anew and whole."""
    try:
        return spark.read.schema(schema).parquet(batch_path(root, table, batch_id - 1))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_batches(spark: SparkSession, root: str, table: str, schema: str, before: int | None = None) -> DataFrame:
    """Everything written so far to ``table``; with ``before``, the earlier batches only.

    The schema is given, so that a table without any batch is simply empty.
    """
    folder = os.path.join(root, table)
    columns = schema + ", batch_id int"
    try:
        rows = spark.read.schema(columns).option("basePath", folder).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def _runs(batches: int) -> list[int]:
    """Ids of the batches whose folders hold the merged rows of the first ``batches`` ones: one for each binary digit."""
    out = []
    while batches:
        out.append(batches - 1)
        batches &= batches - 1
    return out


def merged_handler(root: str, table: str, schema: str, rows_of: Callable[[DataFrame], DataFrame],
                   merge: Callable[[DataFrame], DataFrame]) -> Handler:
    """Handler for :func:`run_batches` that keeps a keyed table in merged runs.

    Batch n merges its rows with those of the batches before it, as many as the largest power of two that divides n, so the
    first n batches always lie in at most log2(n) + 1 folders.  What to merge follows from the number of the batch and
    folders are never changed afterwards, so a replayed batch writes the same, and a reader needs no other file.
    """
    def handle(batch: DataFrame, batch_id: int) -> Iterator[tuple]:
        number = batch_id + 1
        kept = set(_runs(number))
        found = rows_of(batch)
        for earlier in _runs(batch_id):
            if earlier not in kept:
                found = found.unionByName(batch.sparkSession.read.schema(schema).parquet(batch_path(root, table, earlier)))
        yield table, merge(found)

    return handle


def read_merged(spark: SparkSession, root: str, table: str, schema: str, last_batch: int) -> DataFrame:
    """The merged runs after batch ``last_batch``; a key may be in several, so the caller merges once more."""
    if last_batch < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[batch_path(root, table, b) for b in _runs(last_batch + 1)])
