"""The paged feed of a service as a data source (S14, S24): captured pages by offset, read as a batch or as a stream.

A page lies in `<path>/offset=<n>/`, as the service gave it: a JSON array, empty at the feed's end. Each page is a partition,
read where the task runs; the driver only lists folders. A stream keeps the offset after the last page it took in its
checkpoint, so a restarted stream reads no page twice; it takes pages in order and stops before a page that is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from merchantry.session import ship_package


class Page(InputPartition):
    def __init__(self, offset: int) -> None:
        self.offset = offset


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _offsets(path: str) -> list[int]:
    system, folder = _opened(path)
    found = system.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(int(f.base_name.removeprefix("offset=")) for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith("offset="))


def _read(path: str, offset: int) -> Iterator[tuple[int, str]]:
    system, folder = _opened(path)
    for file in system.get_file_info(pafs.FileSelector(f"{folder}/offset={offset}")):
        if file.is_file and not file.base_name.startswith(("_", ".")):
            with system.open_input_stream(file.path) as f:
                yield offset, f.read().decode()


class FeedReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Page]:
        return [Page(n) for n in _offsets(self.path)]

    def read(self, partition: Page | None) -> Iterator[tuple[int, str]]:
        return iter(()) if partition is None else _read(self.path, partition.offset)  # None: there is no page


class FeedStream(DataSourceStreamReader):
    """Offsets are those of the service: the first row that has not been taken. count: rows of a full page."""

    def __init__(self, path: str, count: int) -> None:
        self.path, self.count, self.next = path, count, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        there = set(_offsets(self.path))
        while self.next in there:
            self.next += self.count
        return {"offset": self.next}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(n) for n in range(start["offset"], end["offset"], self.count)]

    def read(self, partition: Page) -> Iterator[tuple[int, str]]:
        return _read(self.path, partition.offset)

    def commit(self, end: dict) -> None:
        pass


class PagedFeed(DataSource):
    """Options: path, and for streams count."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "offset long, page string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeedReader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return FeedStream(self.options["path"], int(self.options["count"]))


def _rows(pages: DataFrame, item: str) -> DataFrame:
    return pages.select("offset", F.explode(F.from_json("page", f"array<{item}>")).alias("row")).select("offset", "row.*")


def feed(spark: SparkSession, path: str, item: str) -> DataFrame:
    """offset and the fields of each element of all captured pages. item: the schema of an element."""
    ship_package(spark)
    spark.dataSource.register(PagedFeed)
    return _rows(spark.read.format("paged_feed").option("path", path).load(), item)


def feed_stream(spark: SparkSession, path: str, item: str, count: int) -> DataFrame:
    """The same as a stream, pages of count rows."""
    ship_package(spark)
    spark.dataSource.register(PagedFeed)
    return _rows(spark.readStream.format("paged_feed").option("path", path).option("count", str(count)).load(), item)


def capture(rows: DataFrame, place: str, count: int, path: str) -> None:
    """Writes rows as the pages of such a feed. place: a column that numbers the rows from 0; the last page is empty or
    short."""
    others = [c for c in rows.columns if c != place]
    page = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(place, *others))), lambda r: F.struct(*(r[c].alias(c) for c in others))))
    pages = rows.groupBy((F.floor(F.col(place) / count) * count).cast("long").alias("offset")).agg(page.alias("value"))
    pages.repartition("offset").write.mode("append").partitionBy("offset").text(path)
