"""Indexes and stores that change: refreshes, merges of several writers, checked edits."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from weftline.operators import segments, tasks
from weftline.plans.registry import query, scratch, wide
from weftline.plans.sqltext import bm25
from weftline.plans.store_queries import _TASKS, task_table
from weftline.sources import store
from weftline.streaming import poll

_TERMS = ["reinheon", "thanoned", "atoust"]


def whole_texts(files):
    """Each file as one chunk, in the columns of chunk_files()."""
    none = F.array().cast("array<string>")
    return files.select("path", F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit("text").alias("type"), F.lit("").alias("name"), F.lit("").alias("parent"), none.alias("imports"), none.alias("symbols"), F.lit("text").alias("lang"), "text")


@query(f"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' reinheon thanoned' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 AND NOT (doc_id % 5 = 2 AND doc_id % 3 <> 0)
  UNION ALL SELECT doc_id, text || ' atoust' FROM documents WHERE doc_id % 5 = 2 AND doc_id % 3 <> 0), {bm25(_TERMS, "v")}
SELECT state, 'd/' || doc_id || '.txt' AS path, round(score, 6) AS score FROM scored, (VALUES ('segments'), ('merged')) s(state)""")
def refreshed_index(spark, sf):
    """Documents as files: two thirds are indexed, then some are edited, deleted or added, then some again, then all is merged."""
    folder, d = scratch(spark), wide(spark, sf, "documents")
    k, path = F.col("doc_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    first = d.where(k % 5 != 2).select(path.alias("path"), F.lit(1).cast("long").alias("mtime"), "text")
    # Every third text is edited and every seventh goes; the rest of the documents is new, and is edited at once afterwards.
    old = d.where((k % 5 != 2) & (k % 7 != 0)).select(path.alias("path"), F.when(k % 3 == 0, 2).otherwise(1).cast("long").alias("mtime"), F.when(k % 3 == 0, F.concat("text", F.lit(" reinheon thanoned"))).otherwise(F.col("text")).alias("text"))
    new = d.where(k % 5 == 2)
    second = old.unionByName(new.select(path.alias("path"), F.lit(2).cast("long").alias("mtime"), "text"))
    late = new.where((k % 7 != 0) | (k % 3 != 0)).select(path.alias("path"), F.lit(3).cast("long").alias("mtime"), F.concat("text", F.when(k % 3 == 0, " reinheon thanoned").otherwise(" atoust")).alias("text"))
    third = old.unionByName(late)
    for files in (first, second, third):
        segments.refresh(spark, folder, files.select("path", "mtime"), lambda wanted, f=files: f.join(wanted, "path", "left_semi"), whole_texts)

    def ranked(state):
        at = segments.live(spark, folder, "chunks", store.notes(spark, folder)["segments"]).select("id", "path")
        return segments.found(spark, folder, _TERMS).join(at, "id").select(F.lit(state).alias("state"), "path", F.round("score", 6).alias("score"))

    before = ranked("segments")
    segments.compact(spark, folder)
    return before.unionByName(ranked("merged"))


@query(f"""SELECT id, CASE WHEN id % 3 = 0 AND id % 7 <> 1 THEN 'completed' ELSE status END AS status, (retries + CASE WHEN id % 3 = 2 AND id % 7 <> 1 THEN 1 ELSE 0 END)::INT AS retries, 5 AS version FROM ({_TASKS}) WHERE id % 7 <> 1
UNION ALL SELECT -id - 1, 'pending', 0, 5 FROM ({_TASKS}) WHERE id % 11 = 0""")
def merged_store(spark, sf):
    """Four writers at once change, count up, delete and add tasks of one store; none of them loses a row."""
    folder = scratch(spark)
    t = task_table(spark, sf).select("id", "status", "retries")
    store.merge(spark, folder, t)
    stay = t.where("id % 7 <> 1")
    none = t.limit(0)
    work = [
        (stay.where("id % 3 = 0").withColumn("status", F.lit("completed")), None),
        (stay.where("id % 3 = 2").withColumn("retries", F.col("retries") + 1), None),
        (none, t.where("id % 7 = 1")),
        (t.where("id % 11 = 0").select((-F.col("id") - 1).alias("id"), F.lit("pending").alias("status"), F.lit(0).alias("retries")), None),
    ]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda w: store.merge(spark, folder, w[0], gone=w[1]), work))
    return store.read(spark, folder).select("id", "status", "retries", F.lit(store.versions(spark, folder)[-1]).alias("version"))


_EDITS = f"""SELECT CASE WHEN id % 13 = 0 THEN -id - 1 ELSE id END AS id, CASE WHEN id % 4 = 1 THEN 'New ' || prompt END AS prompt, CASE WHEN id % 5 = 1 THEN interval_secs + 7 END AS interval_secs,
CASE WHEN id % 6 = 1 THEN 'a' || (id % 9) WHEN id % 6 = 2 THEN '' END AS agent, CASE WHEN id % 7 = 1 THEN 'asleep' WHEN id % 7 = 2 THEN 'paused' END AS status,
CASE WHEN id % 8 = 1 THEN 'a' || (id % 10) END AS reviewer_agent, CASE WHEN id % 9 = 1 THEN tags || ['edited'] END AS tags FROM ({_TASKS})"""
_CHECKED = f"""e AS ({_EDITS}), c AS (SELECT e.*, list_filter([CASE WHEN prompt IS NOT NULL THEN 'prompt' END, CASE WHEN interval_secs IS NOT NULL THEN 'interval_secs' END, CASE WHEN agent IS NOT NULL THEN 'agent' END,
  CASE WHEN status IS NOT NULL THEN 'status' END, CASE WHEN tags IS NOT NULL THEN 'tags' END, CASE WHEN reviewer_agent IS NOT NULL THEN 'reviewer_agent' END], lambda x: x IS NOT NULL) AS changed FROM e),
k AS (SELECT *, CASE WHEN id < 0 THEN 'no such task' WHEN agent <> '' AND agent NOT IN ('a0', 'a1', 'a2', 'a3', 'a4') THEN 'no such agent' WHEN status = 'asleep' THEN 'no such status'
  WHEN reviewer_agent NOT IN ('a0', 'a1', 'a2', 'a3', 'a4') THEN 'no such reviewer' WHEN len(changed) = 0 THEN 'nothing to change' END AS error FROM c)"""


def edit_table(spark, sf):
    """An edit for every task: of one that isn't there, with agents and states that aren't, of nothing, and good ones."""
    k, t = F.col("id"), task_table(spark, sf)
    name = lambda n: F.concat(F.lit("a"), (k % n).cast("string"))
    return t.select(
        F.when(k % 13 == 0, -k - 1).otherwise(k).alias("id"),
        F.when(k % 4 == 1, F.concat(F.lit("New "), "prompt")).alias("prompt"),
        F.when(k % 5 == 1, F.col("interval_secs") + 7).alias("interval_secs"),
        F.when(k % 6 == 1, name(9)).when(k % 6 == 2, "").alias("agent"),
        F.when(k % 7 == 1, "asleep").when(k % 7 == 2, "paused").alias("status"),
        F.when(k % 8 == 1, name(10)).alias("reviewer_agent"),
        F.when(k % 9 == 1, F.concat("tags", F.array(F.lit("edited")))).alias("tags"),
    )


def agent_table(spark, sf):
    return task_table(spark, sf).select(F.col("agent").alias("name")).distinct()


@query(f"WITH {_CHECKED} SELECT id, array_to_string(changed, ',') AS changed, error FROM k")
def checked_task_edits(spark, sf):
    out = tasks.checked_edits(edit_table(spark, sf), task_table(spark, sf), agent_table(spark, sf))
    return out.select("id", F.array_join("changed", ",").alias("changed"), "error")


@query(f"""WITH {_CHECKED}, t AS ({_TASKS}) SELECT t.id, coalesce(k.prompt, t.prompt) AS prompt, coalesce(k.interval_secs, t.interval_secs)::INT AS interval_secs, coalesce(k.agent, t.agent) AS agent, coalesce(k.status, t.status) AS status,
coalesce(k.reviewer_agent, t.reviewer_agent) AS reviewer_agent, array_to_string(coalesce(k.tags, t.tags), ',') AS tags FROM t LEFT JOIN k ON k.id = t.id AND k.error IS NULL""")
def edited_task_store(spark, sf):
    """The good edits merged into the store, checked against the version that they were made for."""
    folder = scratch(spark)
    store.merge(spark, folder, task_table(spark, sf))
    t = store.read(spark, folder, 1)
    good = tasks.checked_edits(edit_table(spark, sf), t, agent_table(spark, sf)).where(F.col("error").isNull())
    store.merge(spark, folder, tasks.edited(t, good), read_at=1)
    return store.read(spark, folder).select("id", "prompt", "interval_secs", "agent", "status", "reviewer_agent", F.array_join("tags", ",").alias("tags"))


def _tick_sql(before: str, after: str, at: str) -> str:
    """CTEs of one tick: d are the tasks it takes, x what becomes of them, and `after` all tasks afterwards."""
    return f"""{after}_d AS (SELECT *, CASE WHEN status = 'pending' THEN 0 ELSE 1 END AS rank FROM {before} WHERE status IN ('pending', 'review') AND next_run <= {at} ORDER BY rank, pos LIMIT 40),
{after}_c AS (SELECT *, CASE WHEN status = 'pending' AND ok THEN CASE WHEN reviewer_agent IS NOT NULL THEN 'v' WHEN type = 'idle' THEN 'i' ELSE 'c' END WHEN status = 'review' AND (reviewer_agent IS NULL OR ok) THEN 'c'
  WHEN retries + 1 >= max_retries THEN CASE WHEN status = 'pending' AND type = 'idle' THEN 'b' ELSE 'f' END ELSE 'r' END AS k FROM {after}_d),
{after}_x AS (SELECT id, CASE k WHEN 'v' THEN 'review' WHEN 'c' THEN 'completed' WHEN 'f' THEN 'failed' ELSE 'pending' END AS s, CASE WHEN k IN ('i', 'b') THEN 0 WHEN k IN ('f', 'r') THEN retries + 1 ELSE retries END::INT AS r,
  {at} + to_seconds(CASE k WHEN 'v' THEN 0 WHEN 'i' THEN interval_secs WHEN 'b' THEN least(interval_secs * 4, 86400) WHEN 'r' THEN greatest(60, interval_secs) // 2 END) AS n FROM {after}_c),
{after} AS (SELECT b.* REPLACE (coalesce(x.s, b.status) AS status, coalesce(x.r, b.retries) AS retries, coalesce(x.n, b.next_run) AS next_run) FROM {before} b LEFT JOIN {after}_x x USING (id))"""


_TICKS = [f"TIMESTAMP '1997-01-0{d} 00:0{m}:00'" for d, m in ((1, 0), (1, 3), (2, 0))]


@query(f"""WITH t0 AS ({_TASKS}), {", ".join(_tick_sql(f"t{i}", f"t{i + 1}", at) for i, at in enumerate(_TICKS))}
SELECT id, status, retries, epoch(next_run)::BIGINT AS next_run FROM t3""")
def poll_ticks(spark, sf):
    """Three ticks of the poll loop over a store of all tasks, each on what the ones before it have written."""
    folder = scratch(spark)
    t = task_table(spark, sf).withColumn("next_run", F.col("next_run").cast("timestamp"))
    store.merge(spark, folder, t)
    for at in _TICKS:
        poll.tick(spark, folder, lambda taken: taken, F.expr(at), most=40)
    return store.read(spark, folder).select("id", "status", "retries", F.unix_seconds("next_run").alias("next_run"))
