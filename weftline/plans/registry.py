"""The library's queries with their DuckDB counterparts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.places import dealt

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that costs much a row, dealt out as dealt() does."""
    return dealt(read(spark, sf_dir, name))


def scratch(spark) -> str:
    """A folder of its own below the shared one; on a cluster that must be named, since a default would lie on the driver's disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base}/scratch-{uuid.uuid4().hex}"


def _load() -> None:
    from weftline.plans import chunk_queries, event_queries, file_queries, live_queries, markup_queries, more_queries, project_queries, search_queries, source_queries, store_queries, text_queries, versioned_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
