"""Streams that arrive in several runs: folding with timers, and requests joined with answers in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.event_queries import delta_lines
from weftline.plans.registry import query, read, scratch
from weftline.streaming import exchange, live

#: The days on which a new lot of files arrives.
CUTS = ("2024-01-08", "2024-01-15 12:30:00", "2024-01-23 07:00:00")


def lots(rows: DataFrame, at: str) -> list[DataFrame]:
    """The rows before, between and after CUTS."""
    edges = [None, *CUTS, None]
    since = lambda x: F.lit(True) if x is None else F.col(at) >= F.lit(x).cast("timestamp")
    return [rows.where(since(a) & (F.lit(True) if b is None else ~since(b))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def heartbeat(spark, schema, **values) -> DataFrame:
    """A row long after all others, as a source that is idle sends one, to move the watermark on."""
    return spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])


def run(stream: DataFrame, folder: str) -> None:
    """One run over what has arrived; the next takes its state up from the checkpoint."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


FOLD = """WITH l AS (SELECT user_id AS s, event_id AS q, ts, event_type, event_id % 10 = 9 AS done FROM events),
b AS (SELECT *, lag(done) OVER w AS after_done, ts - lag(ts) OVER w > INTERVAL 12 HOURS AS paused FROM l WINDOW w AS (PARTITION BY s ORDER BY q)),
m AS (SELECT *, sum(CASE WHEN after_done OR paused THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY q) AS g FROM b),
c AS (SELECT s, g, CASE WHEN q % 8 >= 4 THEN 1 ELSE 0 END AS i, 'c' || max(q) AS id, string_agg(CASE WHEN q % 16 = 1 THEN 'run' ELSE '' END, '' ORDER BY q) AS name, string_agg(q || ';', '' ORDER BY q) AS args FROM m WHERE q % 4 = 1 AND NOT done GROUP BY ALL),
f AS (SELECT s, g, min(q) AS first, max(q) AS last, coalesce(string_agg(event_type || ' ', '' ORDER BY q) FILTER (WHERE q % 4 = 0 AND NOT done), '') AS content,
  count(*) FILTER (WHERE q % 4 = 0 AND NOT done)::BIGINT AS completion_tokens, coalesce(max(q) FILTER (WHERE q % 4 = 2 AND NOT done), 0)::BIGINT AS total_tokens, NOT bool_or(done) AS interrupted FROM m GROUP BY ALL),
j AS (SELECT s, g, string_agg(i || ':' || id || ':' || name || '(' || args || ')', ' ' ORDER BY i) AS calls FROM c WHERE name <> '' GROUP BY ALL),
x AS (SELECT f.*, coalesce(calls, '') AS calls FROM f LEFT JOIN j USING (s, g)),
r AS (SELECT *, coalesce(sum(CASE WHEN NOT interrupted AND (total_tokens > 0 OR content <> '' OR calls <> '') THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM x),
n AS (SELECT *, count(*) FILTER (WHERE interrupted) OVER (PARTITION BY s, run ORDER BY first)::INT AS retry FROM r)
SELECT s AS stream_id, first, last, content, calls, completion_tokens, total_tokens, interrupted, retry, interrupted AND retry <= 3 AS again FROM n"""


@query(FOLD)
def live_folds(spark, sf):
    """Every event as a line of its user's stream; the lots cut messages in the middle, pauses over twelve hours interrupt."""
    folder = scratch(spark)
    line = F.when(F.col("seq") % 10 == 9, "data: [DONE]").otherwise(F.col("line"))
    rows = delta_lines(spark, sf).withColumn("line", line).join(read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at")), "seq")
    ping = heartbeat(spark, rows.schema, stream_id=-1, seq=-1, at="2030-01-01", line=": ping")
    for lot in [*lots(rows, "at"), ping]:
        lot.write.mode("append").parquet(f"{folder}/in")
        run(live.fold_stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), seconds=12 * 3600), folder)
    calls = F.array_join(F.transform("calls", lambda c: F.concat(c["index"].cast("string"), F.lit(":"), c["id"], F.lit(":"), c["name"], F.lit("("), c["arguments"], F.lit(")"))), " ")
    out = live.retries(spark.read.parquet(f"{folder}/out"), most=3)
    return out.select("stream_id", "first", "last", "content", calls.alias("calls"), "completion_tokens", "total_tokens", "interrupted", "retry", "again")


#: Seconds from a request to its answer, and to the answer that some get again: both sides of the minute that counts.
DELAY, AGAIN = "event_id * 37 % 90", "event_id * 37 % 90 + event_id % 7 - 3"

EXCHANGE = f"""WITH a AS (SELECT event_id AS id, ts + to_seconds({DELAY}) AS t, 'first ' || event_type AS result, CASE WHEN event_id % 11 = 0 THEN 'failed' END AS error FROM events WHERE event_id % 6 <> 0
  UNION ALL SELECT event_id, ts + to_seconds({AGAIN}), 'second', NULL FROM events WHERE event_id % 5 = 0 UNION ALL SELECT -event_id - 1, ts, 'nobody asked', NULL FROM events WHERE event_id % 9 = 0),
b AS (SELECT e.event_id AS id, e.event_type AS method, a.t, a.result, a.error, row_number() OVER (PARTITION BY e.event_id ORDER BY a.t, coalesce(a.error, ''), a.result) AS n
  FROM events e LEFT JOIN a ON a.id = e.event_id AND a.t BETWEEN e.ts AND e.ts + INTERVAL 60 SECONDS)
SELECT id, method, CASE WHEN t IS NULL THEN 'timeout' WHEN error IS NOT NULL THEN 'error' ELSE 'result' END AS state, epoch_us(t)::BIGINT AS answered_us, CASE WHEN error IS NULL THEN result END AS result, error FROM b WHERE n = 1"""


@query(EXCHANGE)
def timed_answers(spark, sf):
    """Every event as a request; answers come late, twice, with an error, not at all, or to nobody."""
    folder = scratch(spark)
    e = read(spark, sf, "events").withColumn("asked_at", F.col("ts").cast("timestamp"))
    after = lambda seconds: F.timestamp_micros(F.unix_micros("asked_at") + F.expr(seconds) * 1_000_000)
    none = F.lit(None).cast("string")
    requests = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("method"), "asked_at")
    once = e.where("event_id % 6 <> 0").select(F.col("event_id").alias("id"), after(DELAY).alias("answered_at"), F.concat(F.lit("first "), "event_type").alias("result"), F.when(F.col("event_id") % 11 == 0, "failed").alias("error"))
    twice = e.where("event_id % 5 = 0").select("event_id", after(AGAIN), F.lit("second"), none)
    unasked = e.where("event_id % 9 = 0").select(-F.col("event_id") - 1, "asked_at", F.lit("nobody asked"), none)
    answers = once.union(twice).union(unasked)
    arrived = lambda like, name: spark.readStream.schema(like.schema).parquet(f"{folder}/{name}")
    asked = [*lots(requests, "asked_at"), heartbeat(spark, requests.schema, asked_at="2030-01-01")]
    came = [*lots(answers, "answered_at"), heartbeat(spark, answers.schema, answered_at="2030-01-01")]
    for a, b in zip(asked, came, strict=True):
        a.write.mode("append").parquet(f"{folder}/requests")
        b.write.mode("append").parquet(f"{folder}/answers")
        run(exchange.answered(arrived(requests, "requests"), arrived(answers, "answers"), seconds=60), folder)
    return spark.read.parquet(f"{folder}/out").select("id", "method", "state", F.unix_micros("answered_at").alias("answered_us"), "result", "error")
