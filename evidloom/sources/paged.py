"""A data source for answers that come in pages: numbered, read by many tasks, or chained by a cursor, read by one.

A page is a JSON object in the folder ``page=<name>`` under the path, which driver and executors share; its
records stand at ``dataPath`` (members by dots) and the name of the page that follows at ``nextField``. A
fetch that fails is tried again after growing pauses. A page that fails for good is passed over, but three
in a row end the read with an error, as does every page that fails with ``strict``; the task that read them
is then run again, from its first page, and others keep what they have.

As a stream, pages are taken up in the order of their numbers, all that are there in a batch, and an offset is the
number of the next page: a batch that is run again reads the same pages. Pages after a gap wait until it is filled.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FAILED_IN_A_ROW = 3


class Unavailable(Exception):
    """A page that is there but cannot be read just now."""


def pause(attempt: int, base: float, most: float) -> float:
    """Seconds before the attempt of that number, from 1: doubled each time, up to ``most``."""
    return min(most, base * 2 ** (attempt - 1))


class Pages:
    """Pages in a folder. Subclasses may fetch from elsewhere: they list and fetch."""

    def __init__(self, path: str):
        self.folder = urlparse(path).path if "://" in path or path.startswith("file:") else path

    def numbers(self) -> list[int]:
        if not os.path.isdir(self.folder):
            return []
        return sorted(int(x[5:]) for x in os.listdir(self.folder) if x.startswith("page=") and x[5:].isdigit())

    def fetch(self, name: str) -> dict | None:
        """The page, or None where there is none."""
        folder = os.path.join(self.folder, f"page={name}")
        if not os.path.isdir(folder):
            return None
        try:
            for part in sorted(os.listdir(folder)):
                if not part.startswith((".", "_")):
                    with open(os.path.join(folder, part), encoding="utf-8") as f:
                        if text := f.read().strip():
                            return json.loads(text)
        except (OSError, ValueError) as e:
            raise Unavailable(f"page {name}: {e}") from e
        raise Unavailable(f"page {name} is empty")


def at(value, path: str):
    for member in path.split(".") if path else ():
        value = value.get(member) if isinstance(value, dict) else None
    return value


class Walk:
    """Fetches pages one after the other, by the options of a read."""

    def __init__(self, options: dict, schema: StructType):
        self.pages = options.get("store", Pages)(options["path"]) if callable(options.get("store")) else Pages(options["path"])
        self.fields = schema.names
        self.data, self.next = options.get("datapath", ""), options.get("nextfield", "next")
        self.attempts, self.base, self.longest = int(options.get("attempts", 3)), float(options.get("pause", 0.1)), float(options.get("longestpause", 5))
        self.strict = options.get("strict", "false") == "true"
        self.failed = 0

    def page(self, name: str) -> dict | None:
        for attempt in range(1, self.attempts + 1):
            try:
                found = self.pages.fetch(name)
                self.failed = 0
                return found
            except Unavailable:
                if attempt < self.attempts:
                    time.sleep(pause(attempt, self.base, self.longest))
        self.failed += 1
        if self.strict or self.failed >= FAILED_IN_A_ROW:
            raise RuntimeError(f"page {name} failed, {self.failed} in a row")
        return None

    def rows(self, page: dict | None) -> Iterator[tuple]:
        for record in (at(page, self.data) if page is not None else None) or ():
            yield tuple(record.get(f) for f in self.fields)


class PageRange(InputPartition):
    def __init__(self, numbers: list[int]):
        super().__init__(numbers)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[InputPartition]:
        if self.options.get("mode") == "cursor":
            return [InputPartition(None)]
        numbers = Pages(self.options["path"]).numbers()
        numbers = numbers[: int(self.options.get("most", len(numbers)))]
        each = max(1, int(self.options.get("pagespertask", 4)))
        return [PageRange(numbers[k : k + each]) for k in range(0, len(numbers), each)] or [PageRange([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        walk = Walk(self.options, self.schema)
        if partition.value is not None:
            for number in partition.value:
                yield from walk.rows(walk.page(str(number)))
            return
        name, most, seen = self.options.get("start", "0"), int(self.options.get("most", 1 << 31)), set()
        while name is not None and len(seen) < most and name not in seen:  # a cursor that comes again would never end
            seen.add(name)
            page = walk.page(name)
            yield from walk.rows(page)
            following = at(page, walk.next) if page is not None else None
            name = None if following is None else str(following)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.schema = options, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """Past the last page that follows the others without a gap."""
        there = Pages(self.options["path"]).numbers()
        return {"page": next((k for k, number in enumerate(there) if k != number), len(there))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        each = max(1, int(self.options.get("pagespertask", 4)))
        return [PageRange(list(range(k, min(k + each, end["page"])))) for k in range(start["page"], end["page"], each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        walk = Walk(self.options, self.schema)
        for number in partition.value:
            yield from walk.rows(walk.page(str(number)))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self):
        raise ValueError("state the columns by .schema(...)")

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self._options(), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return PagedStream(self._options(), schema)
