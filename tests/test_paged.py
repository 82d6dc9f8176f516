"""Paged systems as a format: whole scans, pushed update times, streams that go on where they stopped."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rosterflow.sources import changes as src
from rosterflow.sources import paged

START = dt.datetime(2024, 3, 1)
SCHEMA = "student_id bigint, name string, update_time timestamp_ntz"


def numbers(file):
    """A class of the function's own goes to the workers by value; they do not import tests."""
    class Numbers:
        """Rows by rule: one a minute, as many as a file says."""

        def __init__(self, file):
            self.file = file

        def rows(self, since, upto):
            with open(self.file) as given:
                number = int(given.read())
            every = [(i, f"n{i}", START + dt.timedelta(minutes=i)) for i in range(number)]
            return [r for r in every if (since is None or r[2] > since) and (upto is None or r[2] <= upto)]

        def count(self, since, upto):
            return len(self.rows(since, upto))

        def fetch(self, since, upto, page, size):
            return self.rows(since, upto)[page * size:(page + 1) * size]

        def latest(self):
            return self.rows(None, None)[-1][2]

    return Numbers(file)


@pytest.fixture
def system(spark, tmp_path):
    file = tmp_path / "rows"
    file.write_text("1000")
    spark.dataSource.register(paged.paged_source("numbers", numbers(str(file)), SCHEMA, size=100))
    return file


def fetch(spark, table, since):
    return spark.read.format("numbers").load()


def test_whole_scan_reads_a_page_a_partition(spark, system):
    rows = src.snapshot_scan(spark, fetch, "student_info", "student_id", "run-1")
    assert rows.rdd.getNumPartitions() == 10
    assert sorted(int(r.after["student_id"]) for r in rows.collect()) == list(range(1000))
    system.write_text("0")
    assert src.snapshot_scan(spark, fetch, "student_info", "student_id", "run-1").count() == 0


def test_update_time_is_pushed_to_the_system(spark, system):
    rows = src.incremental_scan(spark, fetch, "student_info", "student_id", "run-1", "2024-03-01 12:29:00")
    assert rows.rdd.getNumPartitions() == 3
    assert sorted(int(r.after["student_id"]) for r in rows.collect()) == list(range(750, 1000))
    named = fetch(spark, None, None).filter((F.col("update_time") > F.lit("2024-03-01 12:29:00").cast("timestamp_ntz")) & (F.col("name") == "n800"))
    assert [r.student_id for r in named.collect()] == [800]


def test_stream_goes_on_after_a_restart(spark, system, tmp_path):
    def advance():
        query = (spark.readStream.format("numbers").load().writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "ckpt")).start())
        query.processAllAvailable()
        query.stop()
        return sorted(r.student_id for r in spark.read.schema(SCHEMA).parquet(str(tmp_path / "out")).collect())

    assert advance() == list(range(1000))
    system.write_text("1234")
    assert advance() == list(range(1234)) and advance() == list(range(1234))
    assert os.path.isdir(tmp_path / "ckpt")
