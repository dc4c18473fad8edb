"""A paged service as a Spark data source: one partition for each range of pages, with retries and back-off."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rankloom.operators.dedup import wins


def with_retries(call: Callable[[], str], attempts: int = 5, delay: float = 1.0, longest: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Call until it succeeds; the delay doubles, up to the longest."""
    for attempt in range(attempts):
        try:
            return call()
        except OSError:
            if attempt + 1 == attempts:
                raise
            sleep(min(longest, delay * 2**attempt))
    raise AssertionError("unreachable")


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


def fetch_page(template: str, number: int) -> list | None:
    """The bindings of a page, a file or URL of JSON; null for a page that is not there."""
    from urllib.error import HTTPError
    from urllib.request import urlopen

    place = template.replace("{page}", str(number))

    def fetch() -> str:
        if "://" in place and not place.startswith("file:"):
            try:
                with urlopen(place, timeout=60) as answer:
                    return answer.read().decode("utf-8")
            except HTTPError as error:
                if error.code == 404:
                    raise FileNotFoundError(place) from error
                raise
        with open(place.removeprefix("file://").removeprefix("file:"), encoding="utf-8") as answer:
            return answer.read()

    try:
        return json.loads(with_retries(fetch, attempts=3, delay=0.05))["results"]["bindings"]
    except FileNotFoundError:
        return None


def last_page(full: Callable[[int], bool]) -> int:
    """The number of pages up to the first that is not full, that one included, by doubling and halving."""
    if not full(0):
        return 1
    low, high = 0, 1
    while full(high):
        low, high = high, 2 * high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if full(middle) else (low, middle)
    return high + 1


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.template, self.pages, self.size = options["template"], int(options.get("pages", "0")), int(options.get("size", "0"))

    def partitions(self) -> list[Page]:
        """One for each page; without a number of pages the first page with fewer than ``size`` bindings is the last."""
        pages = self.pages or last_page(lambda i: len(fetch_page(self.template, i) or ()) >= max(self.size, 1))
        return [Page(i) for i in range(pages)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for i, row in enumerate(fetch_page(self.template, partition.number) or ()):
            yield partition.number, i, json.dumps(row, ensure_ascii=False, sort_keys=True)


class PagedBindings(DataSource):
    """``spark.read.format("rankloom_pages").option("template", ".../{page}.json").option("pages", n)``"""

    @classmethod
    def name(cls) -> str:
        return "rankloom_pages"

    def schema(self) -> str:
        return "page int, place int, binding string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_pages(spark: SparkSession, template: str, pages: int = 0, size: int = 0) -> DataFrame:
    """(surface, reading, qid): the first binding of each (surface, reading); pages are counted where their size is given."""
    spark.dataSource.register(PagedBindings)
    raw = spark.read.format("rankloom_pages").option("template", template).option("pages", pages).option("size", size).load()
    value = lambda name: F.get_json_object("binding", f"$.{name}.value")
    rows = raw.select(value("label").alias("surface"), value("kana").alias("reading"), value("item").alias("qid"), F.struct("page", "place").alias("o")).filter("surface <> '' AND reading <> ''")
    return wins(rows, ["surface", "reading"], "o").select("surface", "reading", "qid")
