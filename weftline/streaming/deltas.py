"""Server-sent events and delta streams, folded into messages, in batch or in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CALL = "struct<index:int,id:string,function:struct<name:string,arguments:string>>"
DELTA = f"""struct<usage:struct<prompt_tokens:long,completion_tokens:long,total_tokens:long,cost:double>,
choices:array<struct<delta:struct<content:string,reasoning_content:string,tool_calls:array<{CALL}>>>>>"""


def assemble_events(lines: DataFrame, by: str = "stream_id", order: str = "seq", line: str = "line") -> DataFrame:
    """(by, event, data): data lines up to a blank line are one event, joined by line feeds."""
    w = Window.partitionBy(by).orderBy(order)
    rows = lines.withColumn("event", F.coalesce(F.sum(F.when(F.col(line) == "", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.where(F.col(line).startswith("data:")).withColumn("_d", F.regexp_replace(line, "^data: ?", ""))
    parts = F.array_sort(F.collect_list(F.struct(order, "_d")))
    return rows.groupBy(by, "event").agg(F.array_join(F.transform(parts, lambda x: x["_d"]), "\n").alias("data"))


def parse_deltas(lines: DataFrame, by: str = "stream_id", order: str = "seq", line: str = "line") -> DataFrame:
    """(by, order, delta, usage) of the data lines that parse; what is not JSON is passed over."""
    rows = lines.where(F.col(line).startswith("data: ")).select(by, order, F.trim(F.substring(line, 7, 1_000_000_000)).alias("_d"))
    rows = rows.where(F.col("_d") != "[DONE]").withColumn("_j", F.from_json("_d", DELTA)).where(F.col("_j").isNotNull())
    return rows.select(by, order, F.get("_j.choices", F.lit(0))["delta"].alias("delta"), F.col("_j.usage").alias("usage"))


def _joined(value: Column, order: str) -> Column:
    parts = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("x")))))
    return F.array_join(F.transform(parts, lambda p: p["x"]), "")


def _last(value: Column, order: str) -> Column:
    return F.coalesce(F.max_by(value, F.when(value > 0, F.col(order))), F.lit(0))


def fold_messages(parsed: DataFrame, by: str = "stream_id", order: str = "seq") -> DataFrame:
    """(by, content, reasoning, prompt_tokens, completion_tokens, total_tokens, cost); usage is the last that is not zero.

    Without reported completion tokens, the number of content deltas stands for them.
    """
    content, u = F.col("delta.content"), "usage."
    counted = F.count_if(content.isNotNull() & (content != ""))
    completion = _last(F.col(u + "completion_tokens"), order)
    return parsed.groupBy(by).agg(
        _joined(content, order).alias("content"),
        F.nullif(_joined(F.col("delta.reasoning_content"), order), F.lit("")).alias("reasoning"),
        _last(F.col(u + "prompt_tokens"), order).alias("prompt_tokens"),
        F.when(completion > 0, completion).otherwise(counted).alias("completion_tokens"),
        _last(F.col(u + "total_tokens"), order).alias("total_tokens"),
        _last(F.col(u + "cost"), order).alias("cost"),
    )


def fold_calls(parsed: DataFrame, by: str = "stream_id", order: str = "seq") -> DataFrame:
    """(by, index, id, name, arguments): fragments of a call's name and arguments joined in order, its last id; nameless calls go."""
    rows = parsed.select(by, order, F.inline("delta.tool_calls")).withColumn("index", F.coalesce("index", F.lit(0)))
    out = rows.groupBy(by, "index").agg(
        F.coalesce(F.max_by("id", F.when(F.col("id").isNotNull(), F.col(order))), F.lit("")).alias("id"),
        _joined(F.col("function.name"), order).alias("name"),
        _joined(F.col("function.arguments"), order).alias("arguments"),
    )
    return out.where(F.col("name") != "")


BLOCK_USAGE = "struct<input_tokens:long,output_tokens:long>"
BLOCK = f"""struct<type:string,index:int,usage:{BLOCK_USAGE},content_block:struct<type:string,id:string,name:string>,
delta:struct<type:string,text:string,partial_json:string,usage:{BLOCK_USAGE}>>"""


def parse_blocks(lines: DataFrame, by: str = "stream_id", order: str = "seq", line: str = "line") -> DataFrame:
    """(by, order, delta, usage) of a stream of content blocks, in the form that parse_deltas() gives, so that it folds alike.

    Text deltas are content; the start of a tool block gives a call its id and
    name, later fragments its arguments. Total tokens are what came in and went out.
    """
    rows = lines.where(F.col(line).startswith("data: ")).select(by, order, F.trim(F.substring(line, 7, 1_000_000_000)).alias("_d"))
    rows = rows.where(F.col("_d") != "[DONE]").withColumn("_j", F.from_json("_d", BLOCK)).where(F.col("_j").isNotNull())
    j = lambda x: F.col(f"_j.{x}")
    is_delta, is_start = j("type") == "content_block_delta", (j("type") == "content_block_start") & (j("content_block.type") == "tool_use")
    text = F.when(is_delta & (j("delta.type") == "text_delta"), j("delta.text"))
    part = F.when(is_delta & (j("delta.type") == "input_json_delta"), j("delta.partial_json"))
    name = F.when(is_start, j("content_block.name"))
    call = F.struct(F.coalesce(j("index"), F.lit(0)).alias("index"), F.when(is_start, j("content_block.id")).alias("id"), F.struct(name.alias("name"), part.alias("arguments")).alias("function"))
    calls = F.when(is_start | part.isNotNull(), F.array(call))
    got, gave = (F.coalesce(j(f"usage.{x}"), j(f"delta.usage.{x}")) for x in ("input_tokens", "output_tokens"))
    total = F.coalesce(got, F.lit(0)) + F.coalesce(gave, F.lit(0))
    usage = F.struct(got.alias("prompt_tokens"), gave.alias("completion_tokens"), total.alias("total_tokens"), F.lit(None).cast("double").alias("cost"))
    delta = F.struct(text.alias("content"), F.lit(None).cast("string").alias("reasoning_content"), calls.alias("tool_calls"))
    return rows.select(by, order, delta.alias("delta"), usage.alias("usage"))


def interrupted(lines: DataFrame, by: str = "stream_id", order: str = "seq", line: str = "line", at: str | None = None, seconds: float = 3.0) -> DataFrame:
    """(by, interrupted): whether a stream ended without its [DONE] line, or with at, paused longer than `seconds` before it."""
    done = F.max(F.col(line).rlike(r"^data:\s*\[DONE\]")).alias("_done")
    if at is None:
        return lines.groupBy(by).agg(done).select(by, (~F.col("_done")).alias("interrupted"))
    w = Window.partitionBy(by).orderBy(order)
    gap = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / 1_000_000
    rows = lines.withColumn("_gap", gap).groupBy(by).agg(done, F.max("_gap").alias("_gap"))
    return rows.select(by, (~F.col("_done") | (F.coalesce("_gap", F.lit(0.0)) > seconds)).alias("interrupted"))
