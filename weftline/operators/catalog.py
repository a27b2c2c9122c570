"""Catalogs, sessions and message routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Calls that change nothing.
READ_ONLY = ("read", "glob", "grep", "question", "webfetch", "websearch", "skill", "skills", "invalid", "fact_read", "episodic_search", "parallel_execute")


def supporting(models: DataFrame, required: list[str], needle: str = "", params: str = "supported_parameters") -> DataFrame:
    """Models that support every required parameter, if any model names its parameters at all, and whose id or name contains needle."""
    rows = models
    if required and params in models.columns:
        named = models.agg((F.count(params) > 0).alias("_named"))
        all_there = F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.col(params), F.array().cast("array<string>")))) == 0
        rows = models.crossJoin(F.broadcast(named)).where(~F.col("_named") | all_there).drop("_named")
    n = needle.lower()
    return rows.where(F.lower("id").contains(n) | F.lower("name").contains(n)) if n else rows


def session_stats(messages: DataFrame, session: str = "conv_id", text: str = "text") -> DataFrame:
    """One row: sessions, messages, characters, and KB of UTF-8 text."""
    body = F.coalesce(F.col(text), F.lit(""))
    kb = F.floor(F.sum(F.octet_length(body)) / 1024).cast("long")
    return messages.agg(F.countDistinct(session).alias("sessions"), F.count("*").alias("messages"), F.sum(F.length(body)).alias("chars"), F.coalesce(kb, F.lit(0)).alias("kb"))


def sorted_sessions(sessions: DataFrame, scored: DataFrame | None = None, key: str = "conv_id", mtime: str = "mtime") -> DataFrame:
    """Sessions, the latest first; with (key, score) rows only those with a score, the best first."""
    if scored is None:
        return sessions.orderBy(F.desc(mtime), key)
    return sessions.join(scored.where(F.col("score") > 0), key).orderBy(F.desc("score"), F.desc(mtime), key)


def all_blocked(results: DataFrame, by: str, text: str = "text", mark: str = "BLOCKED") -> DataFrame:
    """(by, all_blocked): whether every result of a round holds the mark; a null result doesn't."""
    return results.groupBy(by).agg(F.bool_and(F.coalesce(F.col(text).contains(mark), F.lit(False))).alias("all_blocked"))


def memory_used(size: Column, limit: Column) -> Column:
    """How much of a memory's limit is used, in whole per cent, 100 at most."""
    return F.least(F.lit(100), F.floor(size / limit * 100)).cast("long")


def stale(beats: DataFrame, now: Column, at: str = "at", seconds: int = 120) -> DataFrame:
    """Adds stale: whether the last heartbeat is over `seconds` ago, or there was none."""
    age = (F.unix_micros(now) - F.unix_micros(F.col(at).cast("timestamp"))) / 1_000_000
    return beats.withColumn("stale", F.coalesce(age > seconds, F.lit(True)))


def change_config(config: DataFrame, changes: DataFrame, key: str = "name") -> DataFrame:
    """(config's columns, outcome) after add, remove and modify rows; changes have the columns of config, action and at most one row a key.

    add needs a new name, remove and modify one that is there; what a modify row
    leaves null stays. Rows that are refused come back with the reason as
    outcome (duplicate, missing, unnamed) and change nothing.
    """
    own = [c for c in config.columns if c != key]
    named = F.coalesce(F.col("_key"), F.lit("")) != ""
    new = changes.select(F.trim(key).alias("_key"), "action", *[F.col(c).alias(f"_new_{c}") for c in own])
    both = config.withColumn("_old", F.lit(True)).join(new, config[key] == new["_key"], "full")
    there, act = F.coalesce("_old", F.lit(False)), F.col("action")
    outcome = F.when(act.isNull(), "kept").when(~named, "unnamed").when((act == "add") & there, "duplicate").when((act != "add") & ~there, "missing").when(act == "add", "added").when(act == "remove", "removed").otherwise("modified")
    rows = both.withColumn("outcome", outcome).where(F.col("outcome") != "removed")
    value = lambda c: F.when(F.col("outcome") == "modified", F.coalesce(f"_new_{c}", c)).when(F.col("outcome") == "added", F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
    return rows.select(F.coalesce(key, "_key").alias(key), *[value(c) for c in own], "outcome")


def older_than(rows: DataFrame, column: str, now, days: int = 90) -> DataFrame:
    """Rows that retention would drop."""
    return rows.where(F.col(column) < now - F.make_interval(days=F.lit(max(1, days))))


def retained(rows: DataFrame, column: str, now, days: int = 90) -> DataFrame:
    """Rows that retention keeps; those without a time stay."""
    return rows.where(~F.coalesce(F.col(column) < now - F.make_interval(days=F.lit(max(1, days))), F.lit(False)))


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no parent."""
    return rows.join(parents.select(key).distinct(), key, "left_anti")


def best_per_group(scored: DataFrame, rows: DataFrame, group: str, key: str = "doc_id") -> DataFrame:
    """(group, score): the best score of each group that has one."""
    return rows.select(key, group).join(scored.where(F.col("score") > 0), key).groupBy(group).agg(F.max("score").alias("score"))


def server_status(config: DataFrame, clients: DataFrame) -> DataFrame:
    """(server, status): connected, disconnected, or not_initialized without a client."""
    state = F.when(F.col("alive").isNull(), "not_initialized").when(F.col("alive"), "connected").otherwise("disconnected")
    return config.join(clients, "server", "left").select("server", state.alias("status"))


def answered(requests: DataFrame, responses: DataFrame, key: str = "id", seconds: int = 60) -> DataFrame:
    """Requests with their answer within the time limit, else timed_out."""
    r = responses.select(key, F.col("at").alias("_at"), "answer")
    late = F.col("_at").isNull() | (F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) > seconds * 1_000_000)
    return requests.join(r, key, "left").select(key, "at", F.when(~late, F.col("answer")).alias("answer"), late.alias("timed_out"))


def checklist(todos: DataFrame, by: str, order: str) -> DataFrame:
    """(by, text, completed, active): todo lines with their marks, how many are done, and the last one in progress."""
    mark = F.when(F.col("status") == "completed", "[x]").when(F.col("status") == "in_progress", "[~]").when(F.col("status") == "cancelled", "[-]").otherwise("[ ]")
    rows = todos.withColumn("_line", F.concat(F.lit("- "), mark, F.lit(" "), F.col("content")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "_line"))), lambda x: x["_line"])
    active = F.max_by("content", F.when(F.col("status") == "in_progress", F.col(order)))
    return rows.groupBy(by).agg(F.array_join(lines, "\n").alias("text"), F.count_if(F.col("status") == "completed").alias("completed"), active.alias("active"))
