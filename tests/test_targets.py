"""Writes to targets happen whole or not at all."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterflow.sources import targets

SCHEMA = "id bigint, record string"


def rows(spark, low, high):
    return spark.range(low, high, 1, 6).select("id", F.concat(F.lit("r"), F.col("id").cast("string")).alias("record"))


def ids(spark, path):
    return sorted(r.id for r in targets.read_target(spark, path, SCHEMA).collect())


def test_commits_add_up_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "table")
    assert ids(spark, path) == []
    targets.write_target(rows(spark, 0, 500), path)
    targets.write_target(rows(spark, 500, 700), path)
    assert ids(spark, path) == list(range(700))
    targets.write_target(rows(spark, 10, 20), path, "overwrite")
    assert ids(spark, path) == list(range(10, 20))
    targets.write_target(rows(spark, 0, 0), path)
    assert ids(spark, path) == list(range(10, 20))


def test_a_job_that_fails_half_way_leaves_no_row(spark, tmp_path):
    path = str(tmp_path / "table")
    targets.write_target(rows(spark, 0, 10), path)
    broken = rows(spark, 10, 6000).withColumn("record", F.when(F.col("id") == 5999, F.raise_error(F.lit("lost"))).otherwise(F.col("record")))
    with pytest.raises(Exception, match="lost"):
        targets.write_target(broken, path)
    assert ids(spark, path) == list(range(10))
    targets.write_target(rows(spark, 10, 6000), path)
    assert ids(spark, path) == list(range(6000))


def test_a_task_that_is_killed_and_repeated_is_seen_once(spark, tmp_path):
    path = str(tmp_path / "table")
    writer = targets.TargetWriter(path, StructType.fromDDL(SCHEMA), False)
    batches = [pa.record_batch([pa.array([i]), pa.array([f"r{i}"])], names=["id", "record"]) for i in range(4)]

    def killed():
        yield from batches[:2]
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(killed())
    slow, twin, none = writer.write(iter(batches)), writer.write(iter(batches)), writer.write(iter([]))
    assert none.file is None and ids(spark, path) == []
    writer.commit([twin, none, None])
    assert ids(spark, path) == [0, 1, 2, 3]
    writer.abort([slow, None])
    assert not os.path.exists(os.path.join(path, slow.file)) and ids(spark, path) == [0, 1, 2, 3]
