"""Collections, items and files of a service that answers page by page, as a Spark data source.

``GET <url>?start=..&limit=..`` gives a JSON list and states the number of all records in a header. One
request of the driver reads that number; a task then reads a range of pages, each with retries, so the
pages come in parallel and a lost task reads its own pages again. Records stay JSON text, which the
JVM takes apart.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone import schemas

#: The header with the number of records, and the record's part that holds the fields.
TOTAL, DATA = "Total-Results", "data"
#: Fields of an item as the service names them.
ITEM_JSON = f"struct<key: string, itemType: string, title: string, DOI: string, abstractNote: string, date: string, creators: array<{schemas.AUTHOR.simpleString()}>>"
FILE_JSON = "struct<key: string, contentType: string>"


@dataclass(frozen=True)
class Client:
    """GET with retries: of answers that tell of a passing fault (429 and 5xx) and of broken connections."""

    key: str = ""
    retries: int = 5
    wait_s: float = 1.0
    timeout_s: float = 60.0

    def get(self, url: str) -> tuple[bytes, dict]:
        request = urllib.request.Request(url, headers={"Authorization": f"Bearer {self.key}"} if self.key else {})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                    return answer.read(), dict(answer.headers)
            except urllib.error.HTTPError as e:
                if attempt == self.retries or e.code != 429 and e.code < 500:
                    raise
                asked = e.headers.get("Retry-After") or ""
                pause = float(asked) if asked.isdigit() else self.wait_s * 2**attempt
            except (urllib.error.URLError, ConnectionError, TimeoutError):
                if attempt == self.retries:
                    raise
                pause = self.wait_s * 2**attempt
            time.sleep(pause)
        raise AssertionError

    def page(self, url: str, start: int, limit: int) -> tuple[list, int]:
        """Records of a page, and how many there are in all."""
        mark = "&" if urllib.parse.urlsplit(url).query else "?"
        body, headers = self.get(f"{url}{mark}start={start}&limit={limit}")
        found = json.loads(body)
        if not isinstance(found, list):
            raise ValueError("a page is no list")
        return found, int(next((v for k, v in headers.items() if k.lower() == TOTAL.lower()), len(found)))


@dataclass
class Pages(InputPartition):
    start: int
    stop: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        self.url, self.limit, self.per_task = o["path"], int(o.get("limit", 100)), int(o.get("pagespertask", 10))
        self.client = Client(o.get("key", ""), int(o.get("retries", 5)), float(o.get("waits", 1.0)))

    def partitions(self) -> list[Pages]:
        _, total = self.client.page(self.url, 0, 1)
        step = self.limit * self.per_task
        return [Pages(at, min(at + step, total)) for at in range(0, total, step)] or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        at = partition.start
        while at < partition.stop:
            limit = min(self.limit, partition.stop - at)
            found, _ = self.client.page(self.url, at, limit)
            if len(found) > limit:
                raise ValueError("a page has more records than were asked for")
            if not found:
                return  # the collection has shrunk meanwhile
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(found)), pa.int64()), pa.array([json.dumps(x, ensure_ascii=False) for x in found])], ["pos", "record"])
            at += len(found)  # a service may give shorter pages than asked for


class PagedSource(DataSource):
    """``spark.read.format("pages").load(url)``: pos, record. Options: ``limit`` (records a page), ``pagesPerTask``,
    ``retries``, ``waitS`` (doubled for each retry), ``key``."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "pos long, record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def read_pages(spark: SparkSession, url: str, **options) -> DataFrame:
    """pos, record: the records of all pages, each once, in no order; ``pos`` is their place in the listing."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("pages").options(**options).load(url)


def items_of(pages: DataFrame, collection: str) -> DataFrame:
    """Items (:data:`schemas.ITEMS`) of ``pages(pos, record)``; a record that is no item is one of nulls."""
    d = F.from_json("record", f"struct<{DATA}: {ITEM_JSON}>")[DATA]
    names = {"key": "key", "item_type": "itemType", "title": "title", "doi": "DOI", "abstract": "abstractNote", "date": "date", "authors": "creators"}
    return pages.select(F.lit(collection).alias("collection"), "pos", *[d[theirs].alias(ours) for ours, theirs in names.items()])


def collections_of(pages: DataFrame) -> DataFrame:
    """name, key, pos of ``pages(pos, record)``, for :func:`papers.catalog`."""
    d = F.from_json("record", f"struct<{DATA}: struct<name: string, key: string>>")[DATA]
    return pages.select(d["name"].alias("name"), d["key"].alias("key"), "pos")


def fetch_attachments(items: DataFrame, children: Callable[[str], str], file: Callable[[str], str], key: str = "", retries: int = 5, wait_s: float = 1.0, limit: int = 100) -> DataFrame:
    """Attachments (:data:`schemas.ATTACHMENTS`) of ``items(key)``: each item's children, and the content of those that are
    PDF files. ``children`` and ``file`` give the addresses of an item's listing and of a child's file. A file
    that stays away has no content, so the item's next one counts."""
    client = Client(key, retries, wait_s)

    def of(item: str):
        at, total = 0, 1
        while at < total:
            found, total = client.page(children(item), at, limit)
            if not found:
                return
            for i, child in enumerate(found):
                data, content = child.get(DATA) or {}, None
                if data.get("contentType") == "application/pdf":
                    try:
                        content, _ = client.get(file(data["key"]))
                    except OSError:  # of which all of urllib's errors are
                        content = None
                yield item, at + i, data.get("contentType"), content
            at += len(found)

    def run(batches):
        for batch in batches:
            for item in batch.column(0).to_pylist():
                for row in of(item):  # a file at a time
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int64(), pa.string(), pa.binary()))], ["item_key", "pos", "content_type", "content"])

    return items.where("key IS NOT NULL").select("key").mapInArrow(run, schemas.ATTACHMENTS)
