"""A catalogue service as a data source: all pages of a list, read by tasks that each take a range of pages.

The service answers a page with an envelope {data: [..], has_more, total_cards}. The driver asks
for the first page only, to learn how many there are. Answers that tell of a passing fault (429, 5xx, broken
connections) are asked for again, each time later; 404 is an empty list. Each task holds to a number of
requests a second, so that ``tasks * per_second`` bounds the load on the service.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .readers import parse_checked

PASSING = {408, 425, 429, 500, 502, 503, 504}


@dataclass
class Pages(InputPartition):
    """Pages first .. last, and whether pages that the catalogue has got since are read, too."""

    first: int
    last: int
    open_end: bool


class CatalogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.tasks = int(options.get("tasks", "8"))
        self.retries = int(options.get("retries", "4"))
        self.wait = float(options.get("wait", "0.5"))
        self.least = 1 / float(options.get("per_second", "10"))
        self.timeout = float(options.get("timeout", "30"))

    def ask(self, page: int) -> dict:
        """The envelope of a page."""
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(self.url.replace("{page}", str(page)), timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as error:
                if error.code == 404:
                    return {}
                if error.code not in PASSING or attempt == self.retries:
                    raise
            except (urllib.error.URLError, ConnectionError, TimeoutError):
                if attempt == self.retries:
                    raise
            time.sleep(self.wait * 2**attempt)
        raise AssertionError

    def partitions(self) -> list[Pages]:
        first = self.ask(1)
        size = len(first.get("data") or [])
        total = -(-int(first.get("total_cards") or size) // size) if size and first.get("has_more") else 1
        step = -(-total // self.tasks)
        return [Pages(a, min(total, a + step - 1), a + step > total) for a in range(1, total + 1, step)]

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        page, due = partition.first, 0.0
        while True:
            time.sleep(max(0.0, due - time.monotonic()))
            due = time.monotonic() + self.least
            envelope = self.ask(page)
            for card in envelope.get("data") or []:
                yield page, card if isinstance(card, str) else json.dumps(card)
            page += 1
            if page > partition.last and not (partition.open_end and envelope.get("has_more")):
                return


class CatalogSource(DataSource):
    """Format "paged_catalog": page, card (JSON, or the plain text of lists of texts). Options: url with {page}, tasks, per_second, retries, wait, timeout."""

    @classmethod
    def name(cls) -> str:
        return "paged_catalog"

    def schema(self) -> str:
        return "page int, card string"

    def reader(self, schema: StructType) -> CatalogReader:
        return CatalogReader(self.options)


def read_pages(spark: SparkSession, url: str, **options: str | float) -> DataFrame:
    """All pages of a list: page, card."""
    spark.dataSource.register(CatalogSource)
    return spark.read.format("paged_catalog").options(url=url, **{k: str(v) for k, v in options.items()}).load()


def read_catalog(spark: SparkSession, url: str, **options: str | float) -> tuple[DataFrame, DataFrame]:
    """All cards of a list as flat printings, and what did not parse."""
    return parse_checked(read_pages(spark, url, **options), "card")


def read_catalog_names(spark: SparkSession, url: str, **options: str | float) -> DataFrame:
    """All names of a list of texts: name."""
    return read_pages(spark, url, **options).select(F.col("card").alias("name"))
