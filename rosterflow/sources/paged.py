"""Tables that are fetched page by page, as a data source.

A system that hands out rows in pages is described by a :class:`Pages` object.  ``paged_source(name, pages, schema)`` makes a
format of it: ``spark.read.format(name).load()`` reads a page a partition, and a filter ``update_time > t`` goes to the system,
so that an incremental scan fetches the new pages only.  ``spark.readStream.format(name)`` goes on from the last update time
that its checkpoint knows.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Iterator
from typing import Protocol

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, Filter, GreaterThan, InputPartition)
from pyspark.sql.types import StructType

EPOCH = dt.datetime(1970, 1, 1)


class Pages(Protocol):
    """What a paged system must answer; rows updated after ``since`` and, where given, up to ``upto``, in a fixed order."""

    def count(self, since: dt.datetime | None, upto: dt.datetime | None) -> int: ...

    def fetch(self, since: dt.datetime | None, upto: dt.datetime | None, page: int, size: int) -> Iterable[tuple]: ...

    def latest(self) -> dt.datetime:
        """Latest update time of any row that will not be joined by another one of that time."""
        ...


class Page(InputPartition):
    def __init__(self, since: dt.datetime | None, upto: dt.datetime | None, number: int):
        self.since, self.upto, self.number = since, upto, number


def _pages(pages: Pages, since: dt.datetime | None, upto: dt.datetime | None, size: int) -> list[Page]:
    return [Page(since, upto, n) for n in range(math.ceil(pages.count(since, upto) / size))]


class PageReader(DataSourceReader):
    def __init__(self, pages: Pages, size: int, update_time: str):
        self.pages, self.size, self.update_time, self.since = pages, size, update_time, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if isinstance(one, GreaterThan) and one.attribute == (self.update_time,):
                self.since = one.value if self.since is None else max(self.since, one.value)
            else:
                yield one

    def partitions(self) -> list[Page]:
        # Rows without an update time come with a scan that asks for none.
        return _pages(self.pages, self.since, None, self.size)

    def read(self, partition: Page | None) -> Iterator[tuple]:
        # Spark reads one partition without a name where there are no pages.
        if partition is not None:
            yield from self.pages.fetch(partition.since, partition.upto, partition.number, self.size)


class PageStream(DataSourceStreamReader):
    def __init__(self, pages: Pages, size: int):
        self.pages, self.size = pages, size

    def initialOffset(self) -> dict:
        return {"since": EPOCH.isoformat()}

    def latestOffset(self) -> dict:
        return {"since": self.pages.latest().isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        since, upto = (dt.datetime.fromisoformat(offset["since"]) for offset in (start, end))
        return _pages(self.pages, since, upto, self.size)

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from self.pages.fetch(partition.since, partition.upto, partition.number, self.size)


def paged_source(name: str, pages: Pages, schema: str, size: int = 500, update_time: str = "update_time") -> type[DataSource]:
    """A format to register with ``spark.dataSource.register``; ``pages`` goes to the workers, so it must be picklable."""
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> PageReader:
            return PageReader(pages, size, update_time)

        def streamReader(self, schema: StructType) -> PageStream:
            return PageStream(pages, size)

    return Source
