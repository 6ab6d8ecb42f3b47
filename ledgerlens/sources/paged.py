"""A data source for registers that answer in pages: ``spark.read.format("paged")``.

One partition per resource, whose pages are asked for one after the other until a stop rule holds:

1. the page says that there are no more results (HasMoreResults is false);
2. the page is empty;
3. the page doesn't say, but ResultsCount does, and that many rows have come;
4. the page says neither and has fewer rows than were asked for.

Rows are (resource, page, item, failure): an item's JSON, or the reason why a resource ended early. A page that can't be
read or isn't JSON is tried again ``retries`` times, then gives a failure row; the rows before it stay. Filters on
resource choose the partitions, a bound on page ends a resource there; both are pushed down. Pages come from ``Landed``, files in any store that pyarrow reads; another
transport is a class with the same ``page`` method, named by option ``transport`` as module:class.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "resource string, page int, item string, failure string"


class Landed:
    """Pages as files: <path>/resource=<name>/start=<first row>/<any name>."""

    def __init__(self, options: dict[str, str]):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(options["path"])

    def resources(self) -> list[str]:
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(self.root))
        return sorted(x.base_name.removeprefix("resource=") for x in found if x.base_name.startswith("resource="))

    def page(self, resource: str, start: int, end: int) -> str:
        from pyarrow import fs

        files = self.store.get_file_info(fs.FileSelector(f"{self.root}/resource={resource}/start={start}"))
        name = min(x.path for x in files if x.is_file and not x.base_name.startswith(("_", ".")))
        with self.store.open_input_stream(name) as f:
            return f.read().decode()


@dataclass
class Resource(InputPartition):
    name: str
    last_page: int | None


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.chosen: set[str] | None = None
        self.last_page: int | None = int(options["maxpages"]) if "maxpages" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("resource",):
                self._choose({f.value})
            elif isinstance(f, In) and f.attribute == ("resource",):
                self._choose(set(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("page",):
                bound = f.value - isinstance(f, LessThan)
                self.last_page = bound if self.last_page is None else min(bound, self.last_page)
            else:
                yield f

    def _choose(self, names: set[str]) -> None:
        self.chosen = names if self.chosen is None else self.chosen & names

    def _transport(self):
        module, _, name = self.options.get("transport", f"{__name__}:Landed").partition(":")
        return getattr(import_module(module), name)(self.options)

    def partitions(self) -> list[InputPartition]:
        names = self.options["resources"].split(",") if "resources" in self.options else self._transport().resources()
        wanted = [Resource(n, self.last_page) for n in names if self.chosen is None or n in self.chosen]
        return wanted or [Resource("", 0)]

    def read(self, partition: Resource) -> Iterator[tuple]:
        if not partition.name:
            return
        transport, size = self._transport(), int(self.options.get("pagesize", 50))
        page, came = 0, 0
        while partition.last_page is None or page < partition.last_page:
            page += 1
            data, failure = self._page(transport, partition.name, came_before(page, size), size)
            if failure:
                yield partition.name, page, None, failure
                return
            items = data.get("CurrentPageResults") or []
            for item in items:
                yield partition.name, page, json.dumps(item, ensure_ascii=False), None
            came += len(items)
            if is_last(data.get("HasMoreResults"), len(items), data.get("ResultsCount"), came, size):
                return

    def _page(self, transport, resource: str, start: int, size: int) -> tuple[dict, str | None]:
        failure = ""
        for attempt in range(int(self.options.get("retries", 2)) + 1):
            time.sleep(attempt * float(self.options.get("wait", 0)))
            try:
                data = json.loads(transport.page(resource, start, start + size - 1))
            except Exception as e:  # a page's failure is a row, whatever its transport raises
                failure = f"{type(e).__name__}: {e}"[:500]
                continue
            if isinstance(data, dict):
                return data, None
            failure = "not an object"
        return {}, failure


def came_before(page: int, size: int) -> int:
    """The number of a page's first row, from 1."""
    return (page - 1) * size + 1


def is_last(more: bool | None, n: int, count: int | None, came: int, size: int) -> bool:
    """The four stop rules."""
    if more is False or n == 0:
        return True
    if more is None:
        return count is not None and came >= count or n < size
    return False


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})


def read_pages(spark: SparkSession, **options: str) -> DataFrame:
    """The source's rows; filters are pushed down from now on in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(**options).load()
