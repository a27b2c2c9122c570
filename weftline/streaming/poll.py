"""A poll loop: due tasks are taken at every tick."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.tasks import due, transition
from weftline.sources import store


def poll(spark: SparkSession, tasks: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 30, most: int = 3, now: Callable[[], Column] = F.current_timestamp) -> StreamingQuery:
    """Starts a loop that reads tasks() every `seconds` and hands those that are due, with the tick's number, to handle.

    Ticks don't overlap: one that takes longer delays the next. handle writes
    what it decides back, so the next tick sees it.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: handle(due(tasks(), now(), most), n)).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def tick(spark: SparkSession, folder: str, run: Callable[[DataFrame], DataFrame], now: Column, most: int = 3) -> DataFrame:
    """One tick over a store of tasks: takes those that are due, runs them, and merges what becomes of them.

    run gives the taken tasks with ok, their outcome. The changed tasks are
    written against the version that was read, so a task that someone else has
    edited meanwhile isn't overwritten: the tick fails with Conflict, and its
    tasks are due at the next. Gives the tasks as they were written.
    """
    version = store.versions(spark, folder)[-1]
    tasks = store.read(spark, folder, version)
    taken = run(due(tasks, now, most).drop("rank"))
    moved = transition(taken, now)
    new = {"status": F.col("new_status"), "retries": F.col("new_retries"), "next_run": F.coalesce(F.col("new_next_run").cast(tasks.schema["next_run"].dataType), F.col("next_run"))}
    changed = moved.withColumns(new).select(*tasks.columns)
    store.merge(spark, folder, changed, read_at=version)
    return store.read(spark, folder).join(taken.select("id"), "id", "left_semi")
