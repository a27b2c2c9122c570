"""Sessions, tasks, facts, catalogs: tables derived from the star schema by a stated mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import catalog, edits, tasks
from weftline.plans.registry import query, read
from weftline.sources import files

#: Orders as tasks: status, type, reviewer, retries and the rest follow the order's key.
_TASKS = """SELECT o_orderkey AS id, list_extract(['pending', 'running', 'paused', 'completed', 'failed', 'review'], (o_orderkey % 6 + 1)::INT) AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'idle' ELSE 'onehot' END AS type,
'Do ' || o_orderpriority AS prompt, 'a' || (o_custkey % 5) AS agent, CASE WHEN o_orderkey % 5 = 0 THEN 'a1' END AS reviewer_agent, CASE WHEN o_orderkey % 4 = 0 THEN 'r' END AS result, (o_orderkey % 4)::INT AS retries, 3 AS max_retries,
(30 + o_custkey % 600)::INT AS interval_secs, o_orderkey % 7 < 4 AS ok, o_orderdate AS next_run, o_orderdate AS completed_at, o_orderkey AS pos, [o_orderstatus, o_orderpriority] AS tags FROM orders"""
_NOW = "TIMESTAMP '1997-01-01 00:00:00'"


def task_table(spark, sf):
    key = F.col("o_orderkey")
    status = F.get(F.array(*map(F.lit, ["pending", "running", "paused", "completed", "failed", "review"])), (key % 6).cast("int"))
    return read(spark, sf, "orders").select(
        key.alias("id"), status.alias("status"), F.when(key % 2 == 0, "idle").otherwise("onehot").alias("type"), F.concat(F.lit("Do "), F.col("o_orderpriority")).alias("prompt"),
        F.concat(F.lit("a"), (F.col("o_custkey") % 5).cast("string")).alias("agent"), F.when(key % 5 == 0, "a1").alias("reviewer_agent"), F.when(key % 4 == 0, "r").alias("result"),
        (key % 4).cast("int").alias("retries"), F.lit(3).alias("max_retries"), (30 + F.col("o_custkey") % 600).cast("int").alias("interval_secs"), (key % 7 < 4).alias("ok"),
        F.col("o_orderdate").alias("next_run"), F.col("o_orderdate").alias("completed_at"), key.alias("pos"), F.array("o_orderstatus", "o_orderpriority").alias("tags"),
    )


def now():
    return F.expr(_NOW)


@query(f"SELECT id, status FROM ({_TASKS}) WHERE status = 'failed' AND list_contains(tags, 'F')")
def task_filter(spark, sf):
    return tasks.filter_tasks(task_table(spark, sf), "failed", "F").select("id", "status")


@query(f"SELECT id FROM ({_TASKS}) WHERE contains(lower(prompt), 'urgent') AND status IN ('pending', 'running', 'review')")
def duplicate_check(spark, sf):
    return tasks.similar_active(task_table(spark, sf), "URGENT").select("id")


@query(f"WITH h AS (SELECT id FROM ({_TASKS}) WHERE starts_with(id::VARCHAR, '12')) SELECT id, (SELECT count(*) > 1 AND NOT bool_or(id = 12) FROM h) AS ambiguous FROM h WHERE NOT (SELECT bool_or(id = 12) FROM h) OR id = 12")
def id_prefix_lookup(spark, sf):
    return tasks.by_prefix(task_table(spark, sf), "12").select("id", "ambiguous")


@query(f"SELECT id, status, rank FROM (SELECT *, CASE WHEN status = 'pending' THEN 0 ELSE 1 END AS rank FROM ({_TASKS}) WHERE status IN ('pending', 'review') AND next_run <= {_NOW}) ORDER BY rank, pos LIMIT 3")
def due_queue(spark, sf):
    return tasks.due(task_table(spark, sf), now()).select("id", "status", "rank")


@query(f"SELECT d.status, count(t.id)::BIGINT AS n FROM (VALUES ('pending'), ('running'), ('paused'), ('completed'), ('failed'), ('review')) d(status) LEFT JOIN (SELECT * FROM ({_TASKS}) WHERE status <> 'paused') t USING (status) GROUP BY d.status")
def status_rollup_zero_fill(spark, sf):
    return tasks.rollup(task_table(spark, sf).where("status <> 'paused'"))


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def status_rollup(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(f"SELECT id FROM ({_TASKS}) WHERE NOT (status IN ('completed', 'failed') AND completed_at < {_NOW} - INTERVAL 30 DAY)")
def task_prune(spark, sf):
    return tasks.prune(task_table(spark, sf), now()).select("id")


@query(f"SELECT id, CASE WHEN status IN ('pending', 'review') THEN 'paused' ELSE status END AS paused, CASE WHEN status IN ('pending', 'review', 'paused') THEN CASE WHEN reviewer_agent IS NOT NULL AND result IS NOT NULL THEN 'review' ELSE 'pending' END ELSE status END AS resumed FROM ({_TASKS})")
def pause_resume(spark, sf):
    held = tasks.pause_all(task_table(spark, sf)).withColumn("paused", F.col("status"))
    return tasks.resume_all(held).select("id", "paused", F.col("status").alias("resumed"))


@query(f"SELECT id, CASE WHEN id % 10 = 0 THEN 'edited' ELSE prompt END AS prompt FROM ({_TASKS}) UNION ALL SELECT -id, 'new' FROM ({_TASKS}) WHERE id % 100 = 0")
def task_upsert(spark, sf):
    t = task_table(spark, sf)
    changes = t.where("id % 10 = 0").withColumn("prompt", F.lit("edited")).unionByName(t.where("id % 100 = 0").withColumns({"id": -F.col("id"), "prompt": F.lit("new")}))
    return tasks.upsert(t, changes).select("id", "prompt")


@query(f"SELECT id, greatest(60, interval_secs) // 2 AS retry, least(interval_secs * 4, 86400) AS idle, least(power(2, retries) * 5, 120)::DOUBLE AS backoff FROM ({_TASKS})")
def retry_backoff(spark, sf):
    t = task_table(spark, sf)
    return t.select("id", tasks.retry_delay(F.col("interval_secs")).cast("long").alias("retry"), tasks.idle_backoff(F.col("interval_secs")).alias("idle"), tasks.exponential(F.col("retries")).cast("double").alias("backoff"))


@query(f"""WITH t AS (SELECT *, status = 'pending' AS doing, type = 'idle' AS idle, reviewer_agent IS NOT NULL AS rev, retries + 1 >= max_retries AS spent FROM ({_TASKS}) WHERE status IN ('pending', 'review')),
c AS (SELECT *, CASE WHEN doing AND ok THEN CASE WHEN rev THEN 'v' WHEN idle THEN 'i' ELSE 'c' END WHEN NOT doing AND (NOT rev OR ok) THEN 'c' WHEN spent THEN CASE WHEN doing AND idle THEN 'b' ELSE 'f' END ELSE 'r' END AS k FROM t)
SELECT id, CASE k WHEN 'v' THEN 'review' WHEN 'c' THEN 'completed' WHEN 'f' THEN 'failed' ELSE 'pending' END AS new_status, CASE WHEN k IN ('i', 'b') THEN 0 WHEN k IN ('f', 'r') THEN retries + 1 ELSE retries END AS new_retries,
CASE k WHEN 'v' THEN 0 WHEN 'i' THEN interval_secs WHEN 'b' THEN least(interval_secs * 4, 86400) WHEN 'r' THEN greatest(60, interval_secs) // 2 END::BIGINT AS delay, k IN ('c', 'f') AS done FROM c""")
def task_transition(spark, sf):
    t = task_table(spark, sf).where(F.col("status").isin("pending", "review"))
    return tasks.transition(t, now()).select("id", "new_status", "new_retries", "delay", "done")


@query(f"SELECT id, CASE WHEN agent IN ('a0', 'a1', 'a2') THEN 'prompt of ' || agent END AS system_prompt, agent IN ('a0', 'a1', 'a2') AS known FROM ({_TASKS})")
def task_agents(spark, sf):
    agents = spark.createDataFrame([(f"a{i}", f"prompt of a{i}") for i in range(3)], "name string, system_prompt string")
    return tasks.with_agent(task_table(spark, sf), agents).select("id", "system_prompt", "known")


@query("SELECT count(DISTINCT conv_id)::BIGINT AS sessions, count(*)::BIGINT AS messages, sum(len(coalesce(text, '')))::BIGINT AS chars, (sum(strlen(coalesce(text, ''))) // 1024)::BIGINT AS kb FROM conversations")
def session_stats(spark, sf):
    return catalog.session_stats(read(spark, sf, "conversations"))


@query("SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY)")
def retention_prune(spark, sf):
    return catalog.retained(read(spark, sf, "events"), "ts", F.expr("TIMESTAMP '2024-01-20 00:00:00'"), 7).select("event_id")


@query("SELECT l.doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def orphan_rows(spark, sf):
    return catalog.orphans(read(spark, sf, "labels"), read(spark, sf, "documents").where("doc_id % 3 <> 0"), "doc_id").select("doc_id")


@query("SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0 AND p_size % 3 = 0 AND contains(lower(p_name), 'a')")
def param_subset(spark, sf):
    params = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "tools"), F.when(F.col("p_size") % 3 == 0, "vision"), F.lit("text")))
    models = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), params.alias("supported_parameters"))
    hits = catalog.supporting(models.withColumn("id", F.col("id").cast("string")), ["tools", "vision"], "A")
    return hits.select(F.col("id").cast("long").alias("id"))


@query("SELECT c_custkey AS server, CASE WHEN c_custkey % 3 = 0 THEN 'not_initialized' WHEN c_custkey % 3 = 1 THEN 'connected' ELSE 'disconnected' END AS status FROM customer")
def server_status(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("server"))
    return catalog.server_status(c, c.where("server % 3 <> 0").withColumn("alive", F.col("server") % 3 == 1))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 1 THEN event_type END AS answer, event_id % 4 <> 1 AS timed_out FROM events")
def pending_requests(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("answer"))
    late = F.when(F.col("id") % 4 == 1, 30).otherwise(90)
    replies = e.where("id % 2 = 1").withColumn("at", F.timestamp_seconds(F.unix_micros(F.col("at").cast("timestamp")) / 1e6 + late))
    return catalog.answered(e.drop("answer"), replies).select("id", "answer", "timed_out")


@query("""WITH t AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'cancelled' ELSE 'pending' END AS s, o_orderpriority AS c FROM orders)
SELECT o_custkey, string_agg('- ' || CASE s WHEN 'completed' THEN '[x]' WHEN 'in_progress' THEN '[~]' WHEN 'cancelled' THEN '[-]' ELSE '[ ]' END || ' ' || c, chr(10) ORDER BY o_orderkey) AS text,
count(*) FILTER (WHERE s = 'completed')::BIGINT AS completed, max_by(c, o_orderkey) FILTER (WHERE s = 'in_progress') AS active FROM t GROUP BY o_custkey""")
def todo_checklist(spark, sf):
    k = F.col("o_orderkey") % 4
    status = F.when(k == 0, "completed").when(k == 1, "in_progress").when(k == 2, "cancelled").otherwise("pending")
    return catalog.checklist(read(spark, sf, "orders").select("o_custkey", "o_orderkey", status.alias("status"), F.col("o_orderpriority").alias("content")), "o_custkey", "o_orderkey")


def every_fact(spark, sf):
    """All customers as facts, forty a store."""
    key = F.col("c_custkey")
    line = F.when(key % 10 == 0, "# heading").when(key % 4 == 0, "<!-- note -->").otherwise(F.concat(F.lit("- likes "), key.cast("string")))
    return read(spark, sf, "customer").select(F.floor(key / 40).cast("string").alias("store"), (key % 40 + 1).cast("int").alias("line_no"), line.alias("line"))


_EVERY_FACT = "SELECT (c_custkey // 40)::VARCHAR AS store, (c_custkey % 40 + 1)::INT AS line_no, CASE WHEN c_custkey % 10 = 0 THEN '# heading' WHEN c_custkey % 4 = 0 THEN '<!-- note -->' ELSE '- likes ' || c_custkey END AS line FROM customer"


@query(f"SELECT * FROM ({_EVERY_FACT}) WHERE contains(lower(line), 'likes 1') AND NOT starts_with(line, '<!--')")
def fact_search(spark, sf):
    return edits.find_facts(every_fact(spark, sf), "LIKES 1")


@query(f"SELECT store, line_no, CASE WHEN store = '0' AND line_no = 2 THEN '- ikes 1' ELSE line END AS line FROM ({_EVERY_FACT}) UNION ALL SELECT '1', 41, '- is new'")
def fact_upsert(spark, sf):
    return edits.upsert_fact(edits.upsert_fact(every_fact(spark, sf), "0", "ikes 1"), "1", "is new")


@query(f"SELECT * FROM ({_EVERY_FACT}) WHERE NOT (store = '1' AND line_no IN (8, 9))")
def fact_delete(spark, sf):
    return edits.remove_fact(edits.remove_fact(every_fact(spark, sf), "1", "likes 47"), "0", "likes 1")


@query("SELECT page_id, coalesce(CASE WHEN page_id % 2 = 0 THEN url END, 'none') AS url, 30 AS timeout FROM pages")
def default_overlay(spark, sf):
    rows = read(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("url")).alias("url"))
    return files.with_defaults(rows, {"url": "none", "timeout": 30})


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-10 00:00:00') - epoch(date_trunc('second', ts)) < 3600")
def catalog_ttl(spark, sf):
    return files.fresh(read(spark, sf, "events"), F.expr("TIMESTAMP '2024-01-10 00:00:00'"), "ts").select("event_id")


@query("SELECT o_orderkey, least(100, floor(o_totalprice / 220000 * 100))::BIGINT AS used FROM orders")
def memory_budget(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", catalog.memory_used(F.col("o_totalprice"), F.lit(220000)).alias("used"))
