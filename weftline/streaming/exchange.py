"""Requests joined with their answers in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = ("answered_at", "result", "error")


def answered(requests: DataFrame, answers: DataFrame, seconds: int = 60, lateness: str = "0 seconds") -> DataFrame:
    """(id, method, asked_at, answered_at, state, result, error): what came of each request; for streams and tables alike.

    requests are (id, method, asked_at), answers (id, answered_at, result, error),
    with times as timestamps. A request takes its first answer within `seconds`;
    of answers at the same time, the one with the least error and result. Later
    answers, those that nobody asked for, and those before the request go
    nowhere. state is `result`, `error`, or `timeout` when none came.

    On streams, both sides are kept only until the watermark says that nothing
    can join them any more: a request comes out when the watermark of both sides
    has passed its time limit. Rows without an id only move the watermark on. An
    id stands for one request: ids that repeat at the same time are one.
    """
    # Keys that are never null, and a filter after the groups: else rows without an id would be filtered before the watermark sees them.
    key = F.to_json(F.struct("id"))
    asked = requests.select(key.alias("_asked"), "id", "method", "asked_at").withWatermark("asked_at", lateness)
    came = answers.select(key.alias("_came"), *ANSWER).withWatermark("answered_at", lateness)
    in_time = F.expr(f"_asked = _came AND answered_at >= asked_at AND answered_at <= asked_at + INTERVAL {int(seconds)} SECONDS")
    pairs = asked.join(came, in_time, "left_outer")
    first = F.min(F.when(F.col("answered_at").isNotNull(), F.struct("answered_at", F.coalesce("error", F.lit("")).alias("_error"), F.coalesce("result", F.lit("")).alias("_result"), "error", "result"))).alias("_first")
    best = pairs.groupBy("_asked", "asked_at").agg(F.first("id").alias("id"), F.first("method").alias("method"), first).where(F.col("id").isNotNull())
    state = F.when(F.col("_first").isNull(), "timeout").when(F.col("_first.error").isNotNull(), "error").otherwise("result")
    return best.select("id", "method", "asked_at", "_first.answered_at", state.alias("state"), F.when(state == "result", F.col("_first.result")).alias("result"), F.col("_first.error").alias("error"))
