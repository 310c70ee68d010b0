"""A paged store as a Spark source: points with payloads, in pages by ascending id, read in parallel and as a stream.

A store is a folder with one file a page, ``page-<first>-<last>.jsonl``, in which each line is a point: a whole number
``id`` and a ``payload``.  Names tell a page's range of ids, so a scan knows its partitions from a listing, and a filter on
the id leaves out whole pages before any is opened.  As a stream the source goes on after the last id it has read.

    spark.dataSource.register(PagedStore)
    spark.read.format("paged_store").option("path", folder).load().where("id >= 5000")
    spark.readStream.format("paged_store").option("path", folder).load()

The folder has to be one that all executors see; a store behind a service takes its place by its own ``pages`` and
``points``.  Payload fields are found by dotted paths (options ``text``, ``document``, ``profile``; several alternatives are
separated by commas), as different writers name them differently.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "id bigint, profile string, document string, text string, payload string"
#: Where a payload's fields are looked for, in this order.
PATHS = {"text": "canonical_text,text,content", "document": "document_id,doc_id,doc", "profile": "profile_id,provenance.profile_id"}
_PAGE = re.compile(r"page-(\d+)-(\d+)\.jsonl$")


@dataclass
class Page(InputPartition):
    path: str
    first: int
    last: int
    #: Ids that are asked for, both ends included.
    low: int | None = None
    high: int | None = None

    def __post_init__(self) -> None:
        super().__init__(self.path)


def pages(folder: str) -> list[Page]:
    """The store's pages in order of their ids."""
    found = [(int(m[1]), int(m[2]), name) for name in os.listdir(folder) if (m := _PAGE.match(name))]
    return [Page(os.path.join(folder, name), first, last) for first, last, name in sorted(found)]


def points(page: Page) -> Iterator[dict]:
    """The page's points, a line at a time."""
    with open(page.path, encoding="utf-8") as lines:
        for line in lines:
            if line.strip():
                yield json.loads(line)


def looked_up(payload: dict, paths: str) -> str | None:
    """The first of the dotted paths at which the payload has something other than null or nothing."""
    for path in paths.split(","):
        at = payload
        for step in path.split("."):
            at = at.get(step) if isinstance(at, dict) else None
        if at not in (None, ""):
            return at if isinstance(at, str) else json.dumps(at, ensure_ascii=False)
    return None


def _rows(page: Page, paths: dict[str, str]) -> Iterator[tuple]:
    for point in points(page):
        if (page.low is None or point["id"] >= page.low) and (page.high is None or point["id"] <= page.high):
            payload = point.get("payload") or {}
            fields = (looked_up(payload, paths[k]) for k in ("profile", "document", "text"))
            yield (point["id"], *fields, json.dumps(payload, ensure_ascii=False, sort_keys=True))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, paths: dict[str, str]):
        self.folder, self.paths = options["path"], paths
        self.low: int | None = None
        self.high: int | None = None
        self.among: set[int] | None = None

    def _at_least(self, value: int) -> None:
        self.low = value if self.low is None else max(self.low, value)

    def _at_most(self, value: int) -> None:
        self.high = value if self.high is None else min(self.high, value)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the id are kept here; everything else stays with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("id",):
                yield f
            elif isinstance(f, EqualTo):
                self._at_least(f.value)
                self._at_most(f.value)
            elif isinstance(f, GreaterThan):
                self._at_least(f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self._at_least(f.value)
            elif isinstance(f, LessThan):
                self._at_most(f.value - 1)
            elif isinstance(f, LessThanOrEqual):
                self._at_most(f.value)
            else:
                if isinstance(f, In):  # pages are chosen by it, rows by Spark
                    self.among = set(f.value) if self.among is None else self.among & set(f.value)
                yield f

    def partitions(self) -> list[Page]:
        chosen = [p for p in pages(self.folder) if (self.low is None or p.last >= self.low) and (self.high is None or p.first <= self.high)]
        if self.among is not None:
            chosen = [p for p in chosen if any(p.first <= v <= p.last for v in self.among)]
        for p in chosen:
            p.low, p.high = self.low, self.high
        return chosen or [Page("", 0, -1)]

    def read(self, page: Page) -> Iterator[tuple]:
        return _rows(page, self.paths) if page.path else iter(())


class _Stream(DataSourceStreamReader):
    """Offsets are the last id read; pages that were written later have larger ids."""

    def __init__(self, options: dict, paths: dict[str, str]):
        self.folder, self.paths = options["path"], paths

    def initialOffset(self) -> dict:
        return {"id": -1}

    def latestOffset(self) -> dict:
        return {"id": max((p.last for p in pages(self.folder)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        chosen = [p for p in pages(self.folder) if p.last > start["id"] and p.first <= end["id"]]
        for p in chosen:
            p.low, p.high = start["id"] + 1, end["id"]
        return chosen

    def read(self, page: Page) -> Iterator[tuple]:
        return _rows(page, self.paths)

    def commit(self, end: dict) -> None:
        """Pages stay in the store."""


class PagedStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_store"

    def schema(self) -> str:
        return SCHEMA

    def _paths(self) -> dict[str, str]:
        return {k: self.options.get(k, PATHS[k]) for k in PATHS}

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), self._paths())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options), self._paths())


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the source known by its name and filters on the id pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedStore)
    return spark


def write_pages(rows: DataFrame, folder: str, page_rows: int = 1000) -> None:
    """``rows`` (id, payload as a map or struct) as a store's pages, written by the tasks that hold them; ids are distinct."""
    from pyspark.sql import functions as F

    ordered = rows.select("id", F.to_json("payload").alias("payload")).where("id is not null").repartitionByRange("id").sortWithinPartitions("id")

    def work(frames):
        import pandas as pd

        held: list[tuple[int, str]] = []

        def out(page: list[tuple[int, str]]) -> None:
            path = os.path.join(folder, f"page-{page[0][0]}-{page[-1][0]}.jsonl")
            with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as file:
                file.writelines(f'{{"id": {k}, "payload": {v}}}\n' for k, v in page)
            os.replace(f"{path}.{os.getpid()}", path)  # a page is there whole or not at all, and a second try writes the same

        n = 0
        for frame in frames:
            for row in zip(frame["id"].tolist(), frame["payload"].tolist(), strict=True):
                held.append(row)
                if len(held) == page_rows:
                    out(held)
                    held, n = [], n + 1
        if held:
            out(held)
            n += 1
        yield pd.DataFrame({"pages": [n]})

    os.makedirs(folder, exist_ok=True)
    ordered.mapInPandas(work, "pages long").agg(F.sum("pages")).collect()
