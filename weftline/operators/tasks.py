"""Task tables: queues, transitions, retention, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "running", "paused", "completed", "failed", "review")


def filter_tasks(tasks: DataFrame, status: str | None = None, tag: str | None = None) -> DataFrame:
    out = tasks.where(F.col("status") == status) if status else tasks
    return out.where(F.array_contains("tags", tag)) if tag else out


def similar_active(tasks: DataFrame, part: str) -> DataFrame:
    """Active tasks whose prompt contains part in any case."""
    return tasks.where(F.lower("prompt").contains(part.lower()) & F.col("status").isin("pending", "running", "review"))


def by_prefix(tasks: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    """The task with this id; else those it is a prefix of, with ambiguous telling whether they are several."""
    hits = tasks.where(F.col(key).cast("string").startswith(prefix))
    count = hits.agg(F.count("*").alias("_n"), F.max(F.col(key).cast("string") == prefix).alias("_exact"))
    rows = hits.crossJoin(F.broadcast(count))
    return rows.where(~F.col("_exact") | (F.col(key).cast("string") == prefix)).withColumn("ambiguous", ~F.col("_exact") & (F.col("_n") > 1)).drop("_n", "_exact")


def due(tasks: DataFrame, now: Column, most: int = 3, order: str = "pos") -> DataFrame:
    """Pending tasks, then those in review, that are due, in file order; at most `most`."""
    ready = tasks.where(F.col("status").isin("pending", "review") & (F.col("next_run") <= now))
    return ready.withColumn("rank", F.when(F.col("status") == "pending", 0).otherwise(1)).orderBy("rank", order).limit(most)


def rollup(tasks: DataFrame, domain: tuple[str, ...] = STATUSES, column: str = "status") -> DataFrame:
    """(column, n) over the whole domain, zeros included."""
    spark = tasks.sparkSession
    names = spark.createDataFrame([(x,) for x in domain], f"{column} string")
    return F.broadcast(names).join(tasks.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def prune(tasks: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Without tasks completed or failed more than days ago."""
    old = F.col("status").isin("completed", "failed") & (F.col("completed_at") < now - F.make_interval(days=F.lit(days)))
    return tasks.where(~F.coalesce(old, F.lit(False)))


def pause_all(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("status", F.when(F.col("status").isin("pending", "review"), "paused").otherwise(F.col("status")))


def resume_all(tasks: DataFrame) -> DataFrame:
    """Paused tasks go back to review if they have a reviewer and a result, else to pending."""
    back = F.when(F.col("reviewer_agent").isNotNull() & F.col("result").isNotNull(), "review").otherwise("pending")
    return tasks.withColumn("status", F.when(F.col("status") == "paused", back).otherwise(F.col("status")))


def upsert(tasks: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of changes take the place of tasks with the same key; others are added."""
    return tasks.join(changes.select(key), key, "left_anti").unionByName(changes)


def retry_delay(interval: Column) -> Column:
    return F.floor(F.greatest(F.lit(60), interval) / 2)


def idle_backoff(interval: Column) -> Column:
    return F.least(interval * 4, F.lit(86_400))


def exponential(attempt: Column, unit: int = 5, most: int = 120) -> Column:
    return F.least(F.pow(F.lit(2), attempt) * unit, F.lit(most))


def transition(tasks: DataFrame, now: Column) -> DataFrame:
    """Adds new_status, new_retries, delay (seconds to the next run, or null) and done (whether it ended now).

    Rows carry status (pending or review), type (onehot or idle), ok (the run's
    or the review's outcome), reviewer_agent, retries, max_retries and
    interval_secs. A work run that succeeds goes to its reviewer, or, without
    one, ends or, if idle, waits its interval. A failure is tried again until
    max_retries; then it fails, or, if idle, backs off. A review without a
    reviewer ends; a passed one too; a failed one returns to work or fails.
    """
    doing, ok, idle = F.col("status") == "pending", F.col("ok"), F.col("type") == "idle"
    reviewer = F.col("reviewer_agent").isNotNull()
    tried = F.col("retries") + 1
    spent = tried >= F.col("max_retries")
    case = (
        F.when(doing & ok & reviewer, "to_review")
        .when(doing & ok & idle, "again")
        .when(doing & ok, "complete")
        .when(~doing & (~reviewer | ok), "complete")
        .when(doing & spent & idle, "back_off")
        .when(spent, "fail")
        .otherwise("retry")
    )
    rows = tasks.withColumn("_case", case)
    is_ = lambda *names: F.col("_case").isin(*names)
    status = F.when(is_("to_review"), "review").when(is_("complete"), "completed").when(is_("fail"), "failed").otherwise("pending")
    retries = F.when(is_("again", "back_off"), 0).when(is_("fail", "retry"), tried).otherwise(F.col("retries"))
    delay = F.when(is_("to_review"), 0).when(is_("again"), F.col("interval_secs")).when(is_("back_off"), idle_backoff(F.col("interval_secs"))).when(is_("retry"), retry_delay(F.col("interval_secs")))
    out = rows.withColumns({"new_status": status, "new_retries": retries.cast("int"), "delay": delay.cast("long"), "done": is_("complete", "fail")})
    return out.withColumn("new_next_run", F.timestamp_seconds(F.unix_seconds(now) + F.col("delay"))).drop("_case")


def unknown_agents(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """(id, role, name) of the agents and reviewers that tasks name and that don't exist; a task may be added if it has none."""
    named = F.array(F.struct(F.lit("agent").alias("role"), F.col("agent").alias("name")), F.struct(F.lit("reviewer").alias("role"), F.col("reviewer_agent").alias("name")))
    rows = tasks.select("id", F.inline(named)).where(F.coalesce("name", F.lit("")) != "")
    return rows.join(agents.select("name").distinct(), "name", "left_anti").select("id", "role", "name")


def with_agent(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Adds the agent's system prompt and known: whether the agent exists."""
    a = agents.select(F.col("name").alias("agent"), "system_prompt", F.lit(True).alias("_known"))
    return tasks.join(a, "agent", "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


#: What an edit may change; a field that is null stays.
EDITABLE = ("prompt", "interval_secs", "max_retries", "agent", "status", "tags", "evaluation_criteria", "reviewer_agent", "review_prompt")


def checked_edits(edits: DataFrame, tasks: DataFrame, agents: DataFrame, key: str = "id") -> DataFrame:
    """edits with changed, the names of the fields they change, and error: null, or why the whole edit is refused.

    Refused are, in this order, edits of a task that isn't there, of an agent
    that isn't, to a status that isn't one, of a reviewer that isn't there, and
    those that change nothing. An empty name takes the agent or reviewer away.
    """
    names = agents.select("name").where(F.col("name").isNotNull()).distinct()
    known = lambda c: names.select(F.col("name").alias(c), F.lit(True).alias(f"_has_{c}"))
    there = tasks.select(F.col(key), F.lit(True).alias("_there")).distinct()
    # Ids compress so well that Spark would broadcast millions of them by their size.
    rows = edits.join(there.hint("merge"), key, "left").join(known("agent"), "agent", "left").join(known("reviewer_agent"), "reviewer_agent", "left")
    missing = lambda c: (F.coalesce(c, F.lit("")) != "") & F.col(f"_has_{c}").isNull()
    given = [f for f in EDITABLE if f in edits.columns]
    changed = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), f) for f in given])).cast("array<string>")
    error = (
        F.when(F.col("_there").isNull(), "no such task")
        .when(missing("agent"), "no such agent")
        .when(F.col("status").isNotNull() & ~F.col("status").isin(*STATUSES), "no such status")
        .when(missing("reviewer_agent"), "no such reviewer")
        .when(F.size(changed) == 0, "nothing to change")
    )
    return rows.select(*edits.columns, changed.alias("changed"), error.alias("error"))


def edited(tasks: DataFrame, accepted: DataFrame, key: str = "id") -> DataFrame:
    """The tasks that accepted edits touch, with their new values."""
    given = [f for f in EDITABLE if f in accepted.columns]
    new = accepted.select(key, *[F.col(f).alias(f"_new_{f}") for f in given])
    rows = tasks.join(new.hint("merge"), key)
    return rows.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in given else F.col(c) for c in tasks.columns])
