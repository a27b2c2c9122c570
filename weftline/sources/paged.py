"""Listings that come in pages, each with the cursor of the next one, as a data source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weftline.sources.places import get, put

Fetch = Callable[[str, str | None], dict]


def _page_file(folder: str, listing: str, cursor: str | None) -> str:
    return f"{folder}/{listing}.{cursor}.json" if cursor else f"{folder}/{listing}.json"


def stored_pages(folder: str) -> Fetch:
    """Fetches from files: <listing>.json first, then <listing>.<cursor>.json."""

    def fetch(listing: str, cursor: str | None) -> dict:
        return json.loads(get(_page_file(folder, listing, cursor)).decode())

    return fetch


def write_pages(items: DataFrame, folder: str, size: int, listing: str = "listing", order: str = "pos", item: str = "item") -> int:
    """Writes items, JSON by listing and place from 0, as files of size items that stored_pages() reads; gives their number. Tasks write them."""
    page = F.floor(F.col(order) / size).cast("long")
    last = F.max(page).over(Window.partitionBy(listing))
    rows = items.select(F.col(listing).alias("l"), page.alias("p"), last.alias("z"), F.col(order).alias("o"), F.col(item).alias("i"))
    docs = rows.groupBy("l", "p", "z").agg(F.array_sort(F.collect_list(F.struct("o", "i"))).alias("x"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                body = {r["l"]: [json.loads(x["i"]) for x in r["x"]]} | ({"nextCursor": str(r["p"] + 1)} if r["p"] < r["z"] else {})
                put(_page_file(folder, r["l"], str(r["p"]) if r["p"] else None), json.dumps(body).encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return docs.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class _Listing(InputPartition):
    def __init__(self, name: str):
        self.name = name


class _Reader(DataSourceReader):
    """A task a listing, since a page is only known from the one before; listings are read side by side."""

    def __init__(self, listings: list[str], fetch: Fetch):
        self.listings, self.fetch = listings, fetch

    def partitions(self) -> list[InputPartition]:
        return [_Listing(x) for x in self.listings]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        cursor, page, seen = None, 0, set()
        while True:
            got = self.fetch(partition.name, cursor)
            for pos, item in enumerate(got.get(partition.name, [])):
                yield partition.name, page, pos, json.dumps(item, sort_keys=True)
            cursor = got.get("nextCursor")
            if not cursor or cursor in seen:  # a cursor that comes back would never end
                return
            seen.add(cursor)
            page += 1


def read_listings(spark: SparkSession, listings: list[str], fetch: Fetch) -> DataFrame:
    """(listing, page, pos, item as JSON) of every page of the listings."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "weftline_paged"

        def schema(self) -> str:
            return "listing string, page int, pos int, item string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(listings, fetch)

    spark.dataSource.register(Paged)
    return spark.read.format("weftline_paged").load()
