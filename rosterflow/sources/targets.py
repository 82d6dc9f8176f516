"""Target tables that a job changes as a whole or not at all.

``df.write.format("roster_target").option("path", folder)`` writes in two phases.  Each task writes a file of its own name
and reports it; only when all tasks are done the driver names the reported files in one commit file, which appears by a
rename.  A reader looks at the files that commits name, so rows of a task that was lost, repeated or run twice, or of a
job that failed, are never seen.  Modes: ``append`` adds a commit, ``overwrite`` adds one that hides all before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

FORMAT = "roster_target"
COMMITS = "_commits"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """File that a task has written, None for one without rows."""

    file: str | None
    rows: int


class TargetWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, to_arrow_schema(schema), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _place(self.path)
        store.create_dir(folder, recursive=True)
        name, rows, out = f"rows-{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{folder}/{name}", self.schema, filesystem=store)
                out.write_table(pa.Table.from_batches([batch]).cast(self.schema))
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _place(self.path)
        store.create_dir(f"{folder}/{COMMITS}", recursive=True)
        last = max([0, *_commits(store, folder)])
        files = sorted(m.file for m in messages if m is not None and m.file)
        # Jobs that commit at the same moment may share a number; their commits both count.
        staged = f"{folder}/{COMMITS}/.{uuid.uuid4().hex}"
        with store.open_output_stream(staged) as out:
            out.write(json.dumps({"overwrite": self.overwrite, "files": files}).encode())
        store.move(staged, f"{folder}/{COMMITS}/{last + 1:020d}-{uuid.uuid4().hex}.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Takes away what the tasks that ended have written; other files stay unseen."""
        store, folder = _place(self.path)
        for message in messages:
            if message is not None and message.file:
                store.delete_file(f"{folder}/{message.file}")


class TargetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> TargetWriter:
        return TargetWriter(self.options["path"], schema, overwrite)


def _commits(store: fs.FileSystem, folder: str) -> dict[int, list[str]]:
    """Commit files by number; jobs that commit at the same time may share one."""
    found: dict[int, list[str]] = {}
    for info in store.get_file_info(fs.FileSelector(f"{folder}/{COMMITS}", allow_not_found=True)):
        if info.base_name.endswith(".json"):
            found.setdefault(int(info.base_name.split("-")[0]), []).append(info.path)
    return found


def committed_files(path: str) -> list[str]:
    """Files that the commits so far name, oldest first, from the last overwriting one on."""
    store, folder = _place(path)
    files: list[str] = []
    for _, own in sorted(_commits(store, folder).items()):
        for name in sorted(own):
            with store.open_input_stream(name) as given:
                commit = json.loads(given.read())
            files = (files if not commit["overwrite"] else []) + commit["files"]
    return files


def write_target(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.sparkSession.dataSource.register(TargetSource)
    rows.write.format(FORMAT).option("path", path).mode(mode).save()


def read_target(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all commits; Spark reads the files themselves."""
    files = committed_files(path)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in files])
