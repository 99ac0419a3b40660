"""A remote catalogue of documents: as a Spark data source, and its rows as items."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RAW = "id string, link string, title string, modified string, added string"


def _post(url: str, page: int) -> list[dict]:
    body = json.dumps({"page": page}).encode()
    with urlopen(Request(url, body, {"Content-Type": "application/json"}), timeout=30) as r:  # noqa: S310
        return json.load(r)


class CatalogReader(DataSourceReader):
    """One partition a page of the catalogue, so that pages are fetched side by side."""

    def __init__(self, options: dict, fetch: Callable[[str, int], list[dict]]):
        self.url, self.pages, self.fetch = options["url"], int(options.get("pages", "1")), fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.pages)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in self.fetch(self.url, partition.value):
            yield tuple(row.get(c.split()[0]) for c in RAW.split(", "))


class CatalogSource(DataSource):
    """``spark.read.format("catalog").option("url", ...)``; tests replace ``fetch``."""

    fetch = staticmethod(_post)

    @classmethod
    def name(cls) -> str:
        return "catalog"

    def schema(self) -> str:
        return RAW

    def reader(self, schema) -> CatalogReader:
        return CatalogReader(self.options, type(self).fetch)


def items(raw: DataFrame) -> DataFrame:
    """external_id, source_url, released: the date of change, else that of addition; blank is null."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return raw.select(F.col("id").alias("external_id"), F.col("link").alias("source_url"), F.coalesce(filled("modified"), filled("added")).alias("released"))


def filtered(df: DataFrame, external_ids: list[str] | None, limit: int | None, order: str) -> DataFrame:
    """The filter comes before the limit; an empty list of ids selects nothing."""
    if external_ids is not None:
        df = df.where(F.col("external_id").isin(external_ids) if external_ids else F.lit(False))
    return df if limit is None else df.orderBy(order).limit(limit)
