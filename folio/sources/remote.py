"""Stand-ins for remote services, as Python data sources with the partitioning that a client would use.

Without a network they read the caches that a client would have left; a client replaces ``rows``.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Ids or records of one request; the most that one search may return; years of a slice beyond it.
BATCH, CEILING = 200, 9_999


def query_between(query: str, start: int, end: int) -> str:
    """A search with its date window; an earlier window is replaced."""
    import re

    base = re.sub(r'\s+AND\s+\("?\d{4}"?(?:/\d\d)*"?\[[A-Z]+\]\s*:\s*"?\d{4}"?(?:/\d\d)*"?\[[A-Z]+\]\)\s*$', "", query)
    return f'{base} AND ("{start}"[PDAT] : "{end}"[PDAT])'


def slices(total: int, start: int, end: int, width: int = 10) -> list[tuple[int, int]]:
    """Year ranges to ask for one by one: the whole if it is small enough, else decades."""
    if total <= CEILING:
        return [(start, end)]
    return [(y, min(end, y + width - 1)) for y in range(start, end + 1, width)]


class Slice(InputPartition):
    """So many rows of the cache from a byte on; with years, those of them alone."""

    def __init__(self, offset: int, rows: int, years: tuple[int, int] | None = None):
        super().__init__((offset, rows, years))
        self.offset, self.rows, self.years = offset, rows, years


def opened(path: str):
    """A binary file on this machine or, by a URI, in a store that Arrow reads."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return io.BufferedReader(store.open_input_file(name))


class CachedReader(DataSourceReader):
    """Rows of a JSON-lines cache, dealt in batches as a client would request them.

    With ``start`` and ``end`` a search of more rows than one may return is asked by ranges of years,
    as rows' ``year`` says; each id comes once all the same, since a row has one year.
    """

    def __init__(self, options: dict, names: list[str]):
        self.path, self.names = options["path"], names
        self.batch = int(options.get("batch", BATCH))
        self.span = (int(options["start"]), int(options["end"])) if "start" in options and "end" in options else None

    def partitions(self) -> list[Slice]:
        starts, total, offset = [], 0, 0
        with opened(self.path) as file:
            for line in iter(file.readline, b""):
                if total % self.batch == 0:
                    starts.append(offset)
                offset, total = offset + len(line), total + 1
        if self.span:
            return [Slice(0, total, years) for years in slices(total, *self.span)]
        return [Slice(at, min(self.batch, total - i * self.batch)) for i, at in enumerate(starts)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        with opened(self.path) as file:
            file.seek(partition.offset)
            for _ in range(partition.rows):
                row = json.loads(file.readline())
                if partition.years is None or partition.years[0] <= int(row.get("year") or 0) <= partition.years[1]:
                    yield tuple(row.get(n) for n in self.names)


def source(name: str, columns: str) -> type[DataSource]:
    """A data source of the given name and schema over such a cache."""

    class Cached(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return CachedReader(self.options, schema.names)

    return Cached


SOURCES = {
    "article_ids": "pmid string",
    "article_counts": "query string, n long",
    "citation_counts": "doi string, citations int",
    "organisations": "key string, ror string, name string, cc string",
}


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format(name)`` known for each of ``SOURCES``."""
    for name, columns in SOURCES.items():
        spark.dataSource.register(source(name, columns))
