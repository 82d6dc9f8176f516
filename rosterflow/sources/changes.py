"""Change-data-capture sources: change log, flattened log, snapshot and incremental scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.functions.times import parse_time

CHANGE_SCHEMA = (
    "sourceTable string, operation string, before map<string,string>, after map<string,string>, "
    "timestamp string, "
    "sourceOffset struct<binlogFile:string, binlogPosition:bigint, gtid:string, timestamp:string>, "
    "transactionId string"
)

Fetcher = Callable[[SparkSession, str, "str | None"], DataFrame]


def parse_changes(raw: DataFrame, value: str = "value") -> DataFrame:
    """Change records from a JSON column; other columns of ``raw`` are kept.

    Works on a batch table and on a stream alike.  A record that is not valid
    JSON, or has an unknown operation, is marked in ``parse_error``.
    """
    kept = [c for c in raw.columns if c != value]
    parsed = raw.withColumn("__c", F.from_json(F.col(value), CHANGE_SCHEMA))
    offset = F.when(
        F.col("__c.sourceOffset").isNotNull(),
        F.struct(
            F.col("__c.sourceOffset.binlogFile").alias("binlog_file"),
            F.col("__c.sourceOffset.binlogPosition").alias("binlog_position"),
        ),
    )
    return parsed.select(
        *kept,
        F.col("__c.sourceTable").alias("source_table"),
        F.col("__c.operation").alias("operation"),
        F.col("__c.before").alias("before"),
        F.col("__c.after").alias("after"),
        parse_time(F.col("__c.timestamp")).alias("ts"),
        offset.alias("source_offset"),
        F.col("__c.sourceOffset.gtid").alias("gtid"),
        parse_time(F.col("__c.sourceOffset.timestamp")).alias("offset_ts"),
        F.col("__c.transactionId").alias("transaction_id"),
        (~F.coalesce(F.col("__c.operation").isin(C.CDC_OPERATIONS), F.lit(False))).alias("parse_error"),
    )


def unwrap_flat(raw: DataFrame, row_schema: str, value: str = "value") -> DataFrame:
    """Flattened log: new row state with a delete marker; tombstones (null values) carry no row."""
    kept = [c for c in raw.columns if c != value]
    parsed = raw.filter(F.col(value).isNotNull()).withColumn(
        "__r", F.from_json(F.col(value), f"{row_schema}, __deleted string"))
    return parsed.select(*kept, "__r.*").withColumn(
        "operation",
        F.when(F.col("__deleted") == "true", F.lit(C.OP_DELETE)).otherwise(F.lit("UPSERT")),
    ).drop("__deleted")


def row_image(columns: list[str]) -> Column:
    """Row as a string map; absent values have no entry."""
    pairs = [part for name in columns for part in (F.lit(name), F.col(name).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _as_changes(rows: DataFrame, table: str, key: str, operation: str, run_id: str) -> DataFrame:
    return rows.select(
        F.lit(table).alias("source_table"),
        F.lit(operation).alias("operation"),
        F.lit(None).cast("map<string,string>").alias("before"),
        row_image(rows.columns).alias("after"),
        F.lit(None).cast("struct<binlog_file:string,binlog_position:bigint>").alias("source_offset"),
        F.concat_ws(":", F.lit(table), F.col(key).cast("string"), F.lit(run_id)).alias("event_id"),
    )


def snapshot_scan(spark: SparkSession, fetch: Fetcher, table: str, key: str, run_id: str) -> DataFrame:
    """Whole table as SNAPSHOT events; the id is table, primary key and run."""
    return _as_changes(fetch(spark, table, None), table, key, C.OP_SNAPSHOT, run_id)


def incremental_scan(
    spark: SparkSession, fetch: Fetcher, table: str, key: str, run_id: str, watermark: str | None,
    update_time: str = "update_time",
) -> DataFrame:
    """Rows updated after the watermark (epoch when there is none) as UPDATE events.

    The comparison is on the bare column, so that it reaches the scan.
    """
    since = watermark or "1970-01-01 00:00:00"
    rows = fetch(spark, table, since).filter(F.col(update_time) > F.lit(since).cast("timestamp_ntz"))
    return _as_changes(rows, table, key, C.OP_UPDATE, run_id)
