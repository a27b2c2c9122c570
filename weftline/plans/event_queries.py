"""Call trails, limits, delta streams: events stand for calls (by user, in time order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import catalog, history, trail
from weftline.plans.registry import query, read
from weftline.streaming import deltas

_CALLS = "SELECT user_id * 100000 + n // 6 AS round, n AS seq, user_id, event_type AS name, '{\"t\": \"' || event_type || '\"}' AS args, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def calls(spark, sf):
    from pyspark.sql import Window

    rows = read(spark, sf, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return rows.select(
        (F.col("user_id") * 100000 + F.floor(F.col("n") / 6)).alias("round"), F.col("n").alias("seq"), "user_id", F.col("event_type").alias("name"),
        F.concat(F.lit('{"t": "'), F.col("event_type"), F.lit('"}')).alias("args"), "ts", "event_id",
    )


@query(f"""WITH c AS ({_CALLS}), l AS (SELECT round, name, row_number() OVER (PARTITION BY round ORDER BY seq DESC) AS back FROM c)
SELECT round, max(name) AS name FROM l WHERE back <= 3 GROUP BY round HAVING count(*) = 3 AND count(DISTINCT name) = 1""")
def repeat_calls(spark, sf):
    return trail.repeat_alerts(calls(spark, sf))


@query(f"""WITH c AS ({_CALLS}), w AS (SELECT event_id, name, row_number() OVER o AS n, lag(name, 1) OVER o AS a, lag(name, 2) OVER o AS b, lag(name, 3) OVER o AS d, lag(name, 4) OVER o AS e, lag(name, 5) OVER o AS f FROM c WINDOW o AS (PARTITION BY user_id ORDER BY seq)),
p AS (SELECT event_id, CASE WHEN n < 6 THEN NULL WHEN name = b AND b = e AND a = d AND d = f AND name <> a THEN 2 WHEN name = d AND a = e AND b = f THEN 3 END AS period FROM w) SELECT * FROM p WHERE period IS NOT NULL""")
def period_pattern(spark, sf):
    return trail.period_pattern(calls(spark, sf), "user_id").select("event_id", "period")


@query("""SELECT event_id, count(*) OVER w AS n, CASE WHEN count(*) OVER w >= 3 THEN round(60 - (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1000000.0, 3) END AS wait
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 53999999 PRECEDING AND 1 PRECEDING)""")
def sliding_rate(spark, sf):
    return trail.window_load(read(spark, sf, "events"), "user_id").select("event_id", "n", F.round("wait", 3).alias("wait"))


_RUN = """island AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isle FROM flagged),
runs AS (SELECT *, sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isle ORDER BY ts, event_id)::BIGINT AS run FROM island)"""


@query(f"WITH flagged AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0 < 15000, false) AS flag FROM events), {_RUN} SELECT event_id, flag AS blocked, run >= 3 AS barred FROM runs")
def min_gap(spark, sf):
    return trail.min_gap(read(spark, sf, "events"), "user_id", seconds=15000).select("event_id", "blocked", "barred")


@query(f"WITH flagged AS (SELECT *, event_type IN ('view', 'click') AS flag FROM events), {_RUN} SELECT event_id, run, run >= 3 AS stuck FROM runs")
def blocked_rounds(spark, sf):
    rows = read(spark, sf, "events").withColumn("flag", F.col("event_type").isin("view", "click"))
    return trail.run_lengths(rows, "user_id", ["ts", "event_id"], "flag", "run").select("event_id", "run", (F.col("run") >= 3).alias("stuck"))


@query(f"WITH flagged AS (SELECT *, event_type <> 'purchase' AS flag FROM events), {_RUN} SELECT user_id, max(run) AS longest, count(*) FILTER (WHERE run >= 12)::BIGINT AS warned FROM runs GROUP BY user_id")
def tool_only_runs(spark, sf):
    rows = read(spark, sf, "events").withColumn("flag", F.col("event_type") != "purchase")
    rows = trail.run_lengths(rows, "user_id", ["ts", "event_id"], "flag", "run")
    return rows.groupBy("user_id").agg(F.max("run").alias("longest"), F.count_if(F.col("run") >= 12).alias("warned"))


@query(f"WITH flagged AS (SELECT *, coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), false) AS flag FROM events), island AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS isle FROM flagged) SELECT event_id, sum(CASE WHEN flag THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isle ORDER BY event_id)::BIGINT AS same FROM island")
def noop_detection(spark, sf):
    return trail.noops(read(spark, sf, "events"), "user_id", "event_id", F.md5(F.col("event_type").cast("binary"))).select("event_id", "same")


@query(f"WITH c AS ({_CALLS}) SELECT event_id, row_number() OVER (PARTITION BY user_id, name ORDER BY seq) > 1 AS again FROM c")
def reread_flag(spark, sf):
    return trail.seen_before(calls(spark, sf), ["user_id", "name"], ["seq"]).select("event_id", "again")


@query("SELECT conv_id, turn, coalesce(max(contains(text, 'the')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS recent FROM conversations")
def duplicate_load(spark, sf):
    return trail.recently_said(read(spark, sf, "conversations"), "conv_id", "turn", "text", "the").select("conv_id", "turn", "recent")


@query(f"WITH c AS ({_CALLS}), w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i, greatest(count(*) OVER (PARTITION BY user_id) - 10, 0)::BIGINT AS dropped FROM c) SELECT event_id, dropped FROM w WHERE i <= 10")
def per_round_cap(spark, sf):
    return trail.cap_rounds(calls(spark, sf), "user_id", ["seq"]).select("event_id", "dropped")


@query("""WITH t AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s AS (SELECT *, sum(len(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY k DESC) AS c, max(k) OVER (PARTITION BY conv_id) AS m FROM t) SELECT conv_id, turn FROM s WHERE c <= 600 OR k = m""")
def history_trim(spark, sf):
    return history.trim_oldest(read(spark, sf, "conversations"), 600).select("conv_id", "turn")


@query("""WITH w AS (SELECT *, role = 'system' AS s, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id, role = 'system') AS n FROM conversations)
SELECT conv_id, turn, role, text FROM w WHERE s OR b <= 3 OR n <= 4 UNION ALL SELECT conv_id, turn, 'marker', '[' || (n - 3) || ' earlier messages dropped]' FROM w WHERE NOT s AND n > 4 AND b = 3""")
def tail_compact(spark, sf):
    return history.compact_tail(read(spark, sf, "conversations"), 3)


@query("SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'system') AS system FROM conversations GROUP BY conv_id")
def split_system(spark, sf):
    return history.split_system(read(spark, sf, "conversations"))


@query("SELECT conv_id, turn, upper(role) || ': ' || substr(coalesce(text, ''), 1, 500) AS line FROM conversations WHERE role IN ('user', 'assistant')")
def role_projection(spark, sf):
    return history.project_roles(read(spark, sf, "conversations")).select("conv_id", "turn", "line")


@query("SELECT conv_id, sum(CASE WHEN turn % 2 = 0 THEN len(text) ELSE len(text) + len(role) END)::BIGINT AS chars FROM conversations GROUP BY conv_id")
def content_length(spark, sf):
    part = F.struct(F.col("text").alias("text"), F.lit(None).cast("string").alias("url"))
    url = F.struct(F.lit(None).cast("string").alias("text"), F.col("role").alias("url"))
    n = history.content_length(F.when(F.col("turn") % 2 == 0, F.col("text")), F.array(part, url))
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(n).alias("chars"))


@query("SELECT user_id, coalesce(max_by(event_id, event_id) FILTER (WHERE event_id % 3 <> 0), 0) AS tokens, round(sum(value), 4) AS cost FROM events GROUP BY user_id")
def usage_totals(spark, sf):
    rows = read(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).otherwise(0).alias("total_tokens"), F.col("value").alias("cost"))
    return history.usage_totals(rows, "user_id", "event_id").select("user_id", "tokens", F.round("cost", 4).alias("cost"))


@query("SELECT doc_id, n_chars // 4 + 2048 AS estimate, least(16384, greatest(1024, 20000 - n_chars // 4 - 2048)) AS answer, 40000 AS history_chars FROM documents")
def token_budget(spark, sf):
    return read(spark, sf, "documents").select("doc_id", *[c.cast("long").alias(k) for k, c in history.token_budget(F.col("n_chars"), F.lit(20000)).items()])


@query("SELECT user_id, bool_and(event_type <> 'purchase') AS all_blocked FROM events GROUP BY user_id")
def all_blocked(spark, sf):
    results = read(spark, sf, "events").select("user_id", F.when(F.col("event_type") != "purchase", "x BLOCKED by rule").otherwise("done").alias("text"))
    return catalog.all_blocked(results, "user_id")


def delta_lines(spark, sf):
    """Events as lines of delta streams, one stream a user: content, a fragment of one of two calls, or usage."""
    e = read(spark, sf, "events")
    kind, i = F.col("event_id") % 4, F.col("event_id").cast("string")
    content = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), F.col("event_type"), F.lit(' "}}]}'))
    call = F.concat(F.lit('data: {"choices":[{"delta":{"tool_calls":[{"index":'), (F.col("event_id") % 8 >= 4).cast("int").cast("string"), F.lit(',"id":"c'), i, F.lit('","function":{"name":"'), F.when(F.col("event_id") % 16 == 1, "run").otherwise(""), F.lit('","arguments":"'), i, F.lit(';"}}]}}]}'))
    usage = F.concat(F.lit('data: {"choices":[],"usage":{"total_tokens":'), F.when(F.col("event_id") % 8 == 3, "0").otherwise(i), F.lit("}}"))
    line = F.when(kind == 0, content).when(kind == 1, call).when(kind == 2, usage).otherwise(F.when(F.col("event_id") % 8 == 3, usage).otherwise("data: not json"))
    return e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), line.alias("line"))


@query("""SELECT user_id AS stream_id, coalesce(string_agg(event_type || ' ', '' ORDER BY event_id) FILTER (WHERE event_id % 4 = 0), '') AS content, count(*) FILTER (WHERE event_id % 4 = 0)::BIGINT AS completion_tokens,
coalesce(max(event_id) FILTER (WHERE event_id % 4 = 2), 0)::BIGINT AS total_tokens FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_id % 8 <> 7) > 0""")
def fold_deltas(spark, sf):
    folded = deltas.fold_messages(deltas.parse_deltas(delta_lines(spark, sf)))
    return folded.select("stream_id", "content", "completion_tokens", "total_tokens")


@query("""SELECT user_id AS stream_id, CASE WHEN event_id % 8 >= 4 THEN 1 ELSE 0 END AS "index", 'c' || max(event_id) AS id, string_agg(CASE WHEN event_id % 16 = 1 THEN 'run' ELSE '' END, '' ORDER BY event_id) AS name, string_agg(event_id || ';', '' ORDER BY event_id) AS arguments
FROM events WHERE event_id % 4 = 1 GROUP BY ALL HAVING bool_or(event_id % 16 = 1)""")
def fold_calls(spark, sf):
    return deltas.fold_calls(deltas.parse_deltas(delta_lines(spark, sf)))


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'data: ' || event_type END AS line FROM events),
g AS (SELECT *, coalesce(sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS event FROM l)
SELECT user_id AS stream_id, event, string_agg(substr(line, 7), chr(10) ORDER BY event_id) AS data FROM g WHERE line <> '' GROUP BY ALL""")
def sse_events(spark, sf):
    line = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("data: "), F.col("event_type")))
    return deltas.assemble_events(read(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), line.alias("line")))
