"""Rows that a service gives page by page, as a data source: a partition for each page, tried again a few times."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quire.shipping import ship


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


def fetched(url: str, attempts: int = 4, wait_s: float = 0.2) -> bytes:
    """What is at a URL or path, tried again with growing pauses; the last error is raised."""
    from urllib.request import urlopen

    for k in range(attempts):
        try:
            with urlopen(url if "://" in url else f"file://{url}", timeout=60) as r:
                return r.read()
        except OSError:
            if k == attempts - 1:
                raise
            time.sleep(wait_s * 2**k)
    raise AssertionError


class Reader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.names = [f.name for f in schema.fields]
        self.url, self.total, self.length = options["url"], int(options["total"]), int(options.get("length", 100))

    def partitions(self) -> list[Page]:
        return [Page(i, min(self.length, self.total - i)) for i in range(0, self.total, self.length)]

    def read(self, partition: Page) -> Iterator[tuple]:
        page = json.loads(fetched(self.url.format(offset=partition.offset, length=partition.length)))
        for row in page["rows"][: partition.length]:
            yield tuple(row["row"].get(n) for n in self.names)


class PagedRows(DataSource):
    """Options: url (with {offset} and {length}), total, length; the schema names the cells that are taken."""

    @classmethod
    def name(cls) -> str:
        return "quire_pages"

    def reader(self, schema) -> Reader:
        return Reader(schema, self.options)


def rows(spark: SparkSession, url: str, total: int, length: int, schema: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(PagedRows)
    return spark.read.format("quire_pages").schema(schema).option("url", url).option("total", total).option("length", length).load()


def cell(url: str, column: str) -> object:
    """One cell of the first row of a page."""
    return json.loads(fetched(url))["rows"][0]["row"][column]
