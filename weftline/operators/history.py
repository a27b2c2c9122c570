"""Conversation history: trimming, compaction, summaries, accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_length(content: Column, parts: Column) -> Column:
    """Characters of a text, or of the texts and picture addresses of a list of parts."""
    return F.when(content.isNotNull(), F.length(content)).otherwise(F.aggregate(parts, F.lit(0), lambda a, p: a + F.coalesce(F.length(p["text"]), F.lit(0)) + F.coalesce(F.length(p["url"]), F.lit(0))))


def trim_oldest(messages: DataFrame, max_chars: int, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Drops whole turns, oldest first, until a conversation has at most max_chars; a turn begins with its user message, and the last turn stays."""
    w = Window.partitionBy(by).orderBy(order)
    rows = messages.withColumn("_turn", F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w))
    after = Window.partitionBy(by).orderBy(F.desc("_turn")).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_chars", F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).over(after)).withColumn("_last", F.max("_turn").over(Window.partitionBy(by)))
    return rows.where((F.col("_chars") <= max_chars) | (F.col("_turn") == F.col("_last"))).drop("_turn", "_chars", "_last")


def trim_eagerly(messages: DataFrame, max_chars: int, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Takes units away, oldest first, until a conversation has at most max_chars or one message that isn't the system's.

    A unit is a user message with all assistant and tool messages right after it,
    or an assistant message that follows none. System messages stay, and so do
    tool messages that no user message leads to.
    """
    w = Window.partitionBy(by).orderBy(order)
    kind = F.col(role)
    answers = kind.isin("assistant", "tool")
    run = F.sum((~answers).cast("int")).over(w)  # a run begins with what isn't an answer
    rows = messages.withColumn("_run", run).withColumn("_led", F.coalesce(F.max((kind == "user").cast("int")).over(Window.partitionBy(by, "_run")), F.lit(0)) == 1)
    begins = (kind == "user") | ((kind == "assistant") & ~F.col("_led"))
    rows = rows.withColumn("_unit", F.sum(begins.cast("int")).over(w)).withColumn("_in", F.col("_led") | (kind == "assistant"))
    chars, whole = F.length(F.coalesce(F.col(text), F.lit(""))), Window.partitionBy(by)
    before = Window.partitionBy(by).orderBy("_unit").rangeBetween(Window.unboundedPreceding, -1)
    left = lambda value, of: F.sum(value).over(whole) - F.coalesce(F.sum(F.when(F.col("_in"), value)).over(of), F.lit(0))
    rows = rows.withColumn("_chars", left(chars, before)).withColumn("_count", left((kind != "system").cast("int"), before))
    goes = F.col("_in") & (F.col("_chars") > max_chars) & (F.col("_count") > 1)
    return rows.where(~F.coalesce(goes, F.lit(False))).drop("_run", "_led", "_unit", "_in", "_chars", "_count")


def history_text(messages: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", call_id: str = "tool_call_id", calls: str = "tool_calls") -> DataFrame:
    """(by, history): a conversation as the text that is summarised: contents cut to 500, arguments of calls to 200, no system messages.

    calls are arrays of (name, arguments); for conversations that fit a row.
    """
    said = F.substring(F.coalesce(F.col(text), F.lit("")), 1, 500)
    tool = F.concat(F.lit("Tool (id="), F.coalesce(F.col(call_id), F.lit("unknown")), F.lit("): "), said, F.lit("\n\n"))
    shown = F.transform(F.coalesce(F.col(calls), F.array().cast("array<struct<name:string,arguments:string>>")), lambda c: F.concat(F.lit("  [tool_call: "), c["name"], F.lit(" args="), F.substring(F.coalesce(c["arguments"], F.lit("")), 1, 200), F.lit("]\n\n")))
    other = F.concat(F.initcap(role), F.lit(": "), said, F.lit("\n\n"), F.array_join(shown, ""))
    rows = messages.where(F.col(role) != "system").select(by, F.struct(F.col(order).alias("o"), F.when(F.col(role) == "tool", tool).otherwise(other).alias("x")).alias("_x"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["x"]), "").alias("history"))


def compact_tail(messages: DataFrame, keep: int = 6, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """System messages and the last `keep` others; where more are dropped, a marker row says how many, just before the tail."""
    w = Window.partitionBy(by, (F.col(role) == "system").alias("_sys"))
    rows = messages.select(by, order, role, text).withColumn("_back", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("_n", F.count("*").over(w))
    tail = rows.where((F.col(role) == "system") | (F.col("_back") <= keep) | (F.col("_n") <= keep + 1))
    mark = rows.where((F.col(role) != "system") & (F.col("_n") > keep + 1) & (F.col("_back") == keep))
    mark = mark.select(by, F.col(order), F.lit("marker").alias(role), F.concat(F.lit("["), (F.col("_n") - keep).cast("string"), F.lit(" earlier messages dropped]")).alias(text))
    return tail.select(by, order, role, text).unionByName(mark)


def split_system(messages: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(by, system): the last system message of each conversation, or null."""
    return messages.groupBy(by).agg(F.max_by(text, order).alias("_x"), F.expr(f"max_by(`{text}`, `{order}`) FILTER (WHERE `{role}` = 'system')").alias("system")).drop("_x")


def head_and_tail(c: Column, limit: int = 3000) -> Column:
    """Short texts as they are; a long line as its ends; long lines as the first three and, of more than six, the last three, cut to limit."""
    cut_mark, gap_mark = " ... (contenido truncado) ...", "... (contenido intermedio omitido para reducir contexto ...) "  # fixed values
    lines = F.split(c, "\n")
    head = (limit - len(cut_mark)) // 2
    tail = limit - len(cut_mark) - head
    ends = F.concat(F.substring(c, 1, head), F.lit(cut_mark), F.substring(c, -tail, tail))
    last = F.when(F.size(lines) > 6, F.slice(lines, -3, 3)).otherwise(F.array().cast("array<string>"))
    block = F.array_join(F.concat(F.slice(lines, 1, 3), F.array(F.lit(gap_mark)), last), "\n")
    return F.when(F.length(c) <= limit, c).when(F.size(lines) == 1, ends).otherwise(F.substring(block, 1, limit))


def usage_totals(rounds: DataFrame, by: str, order: str, tokens: str = "total_tokens", cost: str = "cost") -> DataFrame:
    """(by, tokens, cost): the last total that is not zero, and the sum of costs."""
    return rounds.groupBy(by).agg(F.coalesce(F.expr(f"max_by(`{tokens}`, `{order}`) FILTER (WHERE `{tokens}` > 0)"), F.lit(0)).alias("tokens"), F.sum(cost).alias("cost"))


def token_budget(chars: Column, context: Column) -> dict[str, Column]:
    """Estimated prompt tokens, the answer's budget, and the characters of history that fit."""
    estimate = F.floor(chars / 4) + 2048
    return {"estimate": estimate, "answer": F.least(F.lit(16384), F.greatest(F.lit(1024), context - estimate)), "history_chars": F.floor(context * 0.5 * 4)}


def project_roles(messages: DataFrame, role: str = "role", text: str = "text", limit: int = 500) -> DataFrame:
    """User and assistant messages as one line each, cut."""
    return messages.where(F.col(role).isin("user", "assistant")).withColumn("line", F.concat(F.upper(F.col(role)), F.lit(": "), F.substring(F.coalesce(F.col(text), F.lit("")), 1, limit)))
