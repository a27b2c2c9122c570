"""A source that serves its last snapshot for a while, then fetches, and goes on with the old one if that fails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.sources import store


def cached(spark: SparkSession, folder: str, fetch: Callable[[], DataFrame], now: float, seconds: float = 3600, empty: DataFrame | None = None) -> tuple[DataFrame, str]:
    """(rows, state) of a catalog at the time now, in seconds: `fresh`, `fetched`, `stale` or `none`.

    A snapshot less than `seconds` old is served without fetching, unless it has
    no rows. What is fetched becomes the next snapshot once it is written whole,
    so fetching may fail while rows are read, too; then the old snapshot is
    served, or empty if there has been none. Of two that fetch at once the first
    to finish is kept, and both serve it.
    """
    there = store.versions(spark, folder)
    base = there[-1] if there else 0
    notes = store.notes(spark, folder, base) if base else {}
    if base and notes["rows"] and now - notes["fetched_at"] < seconds:
        return store.read(spark, folder, base), "fresh"
    try:
        rows = fetch()
        store.commit(spark, folder, rows, base, {"fetched_at": now, "rows": rows.limit(1).count()})
        return store.read(spark, folder, base + 1), "fetched"
    except store.Conflict:
        return store.read(spark, folder), "fetched"
    except Exception:  # whatever a fetch may raise, on the driver or in a task
        if base:
            return store.read(spark, folder, base), "stale"
        if empty is None:
            raise
        return empty, "none"
