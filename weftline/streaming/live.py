"""Delta streams folded while they arrive: state by stream, ended by its last line or by a timer."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.streaming import buckets
from weftline.streaming.deltas import DELTA

CALLS = "array<struct<index:int,id:string,name:string,arguments:string>>"


@dataclass
class Message:
    """What has come of a message so far."""

    first: int
    last: int = 0
    at: float | None = None
    content: list[str] = field(default_factory=list)
    reasoning: list[str] = field(default_factory=list)
    calls: dict[int, list[str]] = field(default_factory=dict)
    prompt_tokens: int = 0
    completion_tokens: int = 0
    total_tokens: int = 0
    cost: float = 0.0

    def add(self, row) -> None:
        if row.content:
            self.content.append(row.content)
        if row.reasoning:
            self.reasoning.append(row.reasoning)
        for call in json.loads(row.calls) if row.calls else []:
            own = self.calls.setdefault(call.get("index", 0), ["", "", ""])
            own[0] = call.get("id", own[0])
            own[1] += call.get("name", "")
            own[2] += call.get("arguments", "")
        for name in ("prompt_tokens", "completion_tokens", "total_tokens", "cost"):
            if getattr(row, name) > 0:
                setattr(self, name, getattr(row, name))

    def out(self, key: object, interrupted: bool) -> tuple:
        calls = [{"index": i, "id": c[0], "name": c[1], "arguments": c[2]} for i, c in sorted(self.calls.items()) if c[1]]
        completion = self.completion_tokens or len(self.content)
        return (key, self.first, self.last, "".join(self.content), "".join(self.reasoning) or None, json.dumps(calls), self.prompt_tokens, completion, self.total_tokens, self.cost, interrupted)

    def dump(self) -> dict:
        return vars(self)

    @staticmethod
    def load(x: dict) -> Message:
        return Message(**{**x, "calls": {int(k): v for k, v in x["calls"].items()}})


def parsed(lines: DataFrame, by: str, order: str, line: str, at: str) -> DataFrame:
    """One row a line, parsed before Python sees it; lines that hold no data or no JSON keep their time only."""
    is_data = F.coalesce(F.col(line).startswith("data: "), F.lit(False))
    body = F.when(is_data, F.trim(F.substring(line, 7, 1_000_000_000)))
    rows = lines.select(by, F.col(order).alias("line_order"), F.col(at), is_data.alias("is_data"), (body == "[DONE]").alias("done"), F.from_json(body, DELTA).alias("_j"))
    delta, usage = F.get("_j.choices", F.lit(0))["delta"], F.col("_j.usage")
    part = F.transform(delta["tool_calls"], lambda c: F.struct(F.coalesce(c["index"], F.lit(0)).alias("index"), c["id"].alias("id"), c["function"]["name"].alias("name"), c["function"]["arguments"].alias("arguments")))
    number = lambda name: F.coalesce(usage[name], F.lit(0)).alias(name)
    return rows.select(
        by,
        "line_order",
        at,
        F.unix_micros(F.col(at).cast("timestamp")).alias("line_micros"),
        "is_data",
        F.coalesce("done", F.lit(False)).alias("done"),
        delta["content"].alias("content"),
        delta["reasoning_content"].alias("reasoning"),
        F.to_json(part).alias("calls"),
        *map(number, ("prompt_tokens", "completion_tokens", "total_tokens", "cost")),
    )


def fold_stream(lines: DataFrame, by: str = "stream_id", order: str = "seq", line: str = "line", at: str = "at", seconds: float = 3.0, lateness: str = "0 seconds", clock: str = "event") -> DataFrame:
    """(by, first, last, content, reasoning, calls, tokens, cost, interrupted) of each message of a stream of lines.

    A message begins with a data line and ends with `[DONE]`, or interrupted when
    nothing comes for more than `seconds`; a later data line of the same stream
    begins the next, as a repeated request does. Lines without data, such as
    keep-alives, begin nothing but count as something that came. first and last
    are its data lines' order. Lines of one micro-batch are put in order; across
    batches they must come in order.

    With the event clock, pauses are those of `at`, whatever the batches are, and
    timers follow the watermark, which trails by `lateness`; lines later than that
    are left out. With the processing clock a timer runs from the last batch that
    had lines of the stream. Either way the state of a stream goes with its message.
    """
    event = clock == "event"
    if clock not in ("event", "processing"):
        raise ValueError("clock is event or processing")
    rows = parsed(lines.withWatermark(at, lateness) if event else lines, by, order, line, at)

    def update(key: object, rows: list, kept: dict | None, out: list) -> tuple[dict, int] | None:
        message = Message.load(kept) if kept else None
        for row in rows:
            now = row.line_micros / 1e6 if event else None
            if message and event and now - message.at > seconds:
                out.append(message.out(key, True))
                message = None
            if row.is_data:
                message = message or Message(int(row.line_order))
                message.last = int(row.line_order)
                if row.done:
                    out.append(message.out(key, False))
                    message = None
                else:
                    message.add(row)
            if message:
                message.at = now
        if message:
            return message.dump(), int((message.at + seconds) * 1000) + 1 if event else int(seconds * 1000)
        return None

    def expire(key: object, kept: dict, out: list) -> None:
        out.append(Message.load(kept).out(key, True))

    folded = buckets.fold(rows, by, ["line_order"], ", ".join(f"{k} {v}" for k, v in OUT.items()), update, expire, clock)
    return folded.withColumn("calls", F.from_json("calls", CALLS))


OUT = {"first": "long", "last": "long", "content": "string", "reasoning": "string", "calls": "string", "prompt_tokens": "long", "completion_tokens": "long", "total_tokens": "long", "cost": "double", "interrupted": "boolean"}


def retries(messages: DataFrame, by: str = "stream_id", order: str = "first", most: int = 10) -> DataFrame:
    """messages with retry, the interruptions in a row up to each message, and again: whether it is asked for once more.

    A message that ends well, and one that brought tokens, text or calls, counts
    as a new start for those after it.
    """
    w = Window.partitionBy(by).orderBy(order)
    fruitful: Column = ~F.col("interrupted") & ((F.col("total_tokens") > 0) | (F.col("content") != "") | (F.size("calls") > 0))
    runs = messages.withColumn("_run", F.coalesce(F.sum(fruitful.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    count = F.sum(F.col("interrupted").cast("int")).over(Window.partitionBy(by, "_run").orderBy(order)).cast("int")
    return runs.withColumn("retry", count).withColumn("again", F.col("interrupted") & (F.col("retry") <= most)).drop("_run")
