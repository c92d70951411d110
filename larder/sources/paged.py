"""A paged JSON source as a Python data source: one partition for each page.

Register `PagedSource` with spark.dataSource.register and read format "paged_json". The option `url` holds `{page}`; any scheme
that urllib opens will do. The first page tells the number of pages (one if it doesn't) and must load; later pages that
fail are skipped.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def load(url: str, page: int) -> str:
    with urlopen(url.replace("{page}", str(page))) as answer:  # noqa: S310
        return answer.read().decode()


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.pause = options["url"], float(options.get("pause", "1"))

    def partitions(self) -> list[InputPartition]:
        first = json.loads(load(self.url, 1))
        pages = (first.get("pagination") or {}).get("totalPages", 1)
        return [InputPartition(p) for p in range(1, pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        page = partition.value
        if page > 1:
            time.sleep(self.pause)
        try:
            yield page, load(self.url, page)
        except (OSError, ValueError):
            if page == 1:
                raise
