"""Files written and scanned, histories, tables, admission whose state expires."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import history
from weftline.plans.registry import query, read, scratch
from weftline.sources import files
from weftline.streaming import limits


@query("""SELECT path, md5(text) AS digest, strlen(text)::BIGINT AS bytes FROM (SELECT *, CASE doc_id % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'src/.hidden/' WHEN 3 THEN 'a/dist/b/' WHEN 4 THEN 'ä ö/' WHEN 5 THEN 'src/deep/er/' ELSE '' END || CASE WHEN doc_id % 5 = 1 THEN '.' ELSE '' END || 'd%' || doc_id || '.txt' AS path FROM documents)
WHERE doc_id % 8 NOT IN (1, 2, 3) AND strlen(text) BETWEEN 1 AND 20000""")
def scanned_files(spark, sf):
    """Every text written as a file of its own by tasks, in folders that a scan enters and folders that it skips; large ones are left."""
    folder, k = scratch(spark), F.col("doc_id")
    where = F.get(F.array(*map(F.lit, ["src/", "node_modules/", "src/.hidden/", "a/dist/b/", "ä ö/", "src/deep/er/", "", ""])), (k % 8).cast("int"))
    path = F.concat(where, F.when(k % 5 == 1, ".").otherwise(""), F.lit("d%"), k.cast("string"), F.lit(".txt"))
    files.write_texts(read(spark, sf, "documents").select(path.alias("path"), "text"), folder)
    found = files.scan(spark, folder, 20_000)
    return found.select("path", F.md5("content").alias("digest"), F.col("length").alias("bytes"))


#: Messages of every conversation with some of them as the system's and the tools', a few conversations long enough to be trimmed.
_ROLES = "CASE WHEN turn % 11 = 4 THEN 'system' WHEN turn % 5 = 2 THEN 'tool' WHEN (conv_id + turn) % 3 = 0 THEN 'user' ELSE 'assistant' END"


def _messages(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.expr(_ROLES).alias("role"), "text")


@query(f"""WITH RECURSIVE m AS (SELECT conv_id AS c, list({{'t': turn, 'r': {_ROLES}, 'n': length(coalesce(text, ''))}} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id),
s AS (SELECT c, ms, list_sum(list_transform(ms, lambda x: x.n)) AS total, len(list_filter(ms, lambda x: x.r <> 'system')) AS k, true AS go FROM m UNION ALL
  SELECT c, kept, list_sum(list_transform(kept, lambda x: x.n)), len(list_filter(kept, lambda x: x.r <> 'system')), len(kept) < len(ms) FROM (
    SELECT c, ms, list_concat(ms[:i - 1], ms[i + CASE WHEN ms[i].r = 'user' THEN 1 + coalesce(list_position(list_transform(ms[i + 1:], lambda x: x.r IN ('assistant', 'tool')), false) - 1, len(ms) - i) ELSE 1 END:]) AS kept
    FROM (SELECT *, list_position(list_transform(ms, lambda x: x.r IN ('user', 'assistant')), true) AS i FROM s WHERE go AND coalesce(total, 0) > 400 AND k > 1) WHERE i IS NOT NULL)),
last AS (SELECT c, ms, row_number() OVER (PARTITION BY c ORDER BY len(ms)) AS n FROM s)
SELECT c AS conv_id, x.t AS turn, x.r AS role FROM (SELECT c, unnest(ms) AS x FROM last WHERE n = 1)""")
def eager_trim(spark, sf):
    return history.trim_eagerly(_messages(spark, sf), 400).select("conv_id", "turn", "role")


@query(f"""WITH m AS (SELECT conv_id, turn, text, {_ROLES} AS role FROM conversations)
SELECT conv_id, md5(string_agg(CASE WHEN role = 'tool' THEN 'Tool (id=' || CASE WHEN turn % 2 = 0 THEN 'call_' || turn ELSE 'unknown' END || '): ' ELSE upper(role[1]) || role[2:] || ': ' END || substr(coalesce(text, ''), 1, 500) || chr(10) || chr(10) ||
  CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN '  [tool_call: run' || turn || ' args=' || substr(coalesce(text, ''), 1, 200) || ']' || chr(10) || chr(10) || '  [tool_call: stop args=]' || chr(10) || chr(10) ELSE '' END, '' ORDER BY turn)) AS digest FROM m WHERE role <> 'system' GROUP BY conv_id""")
def history_texts(spark, sf):
    m, turn = _messages(spark, sf), F.col("turn").cast("string")
    call = lambda name, arguments: F.struct(name.alias("name"), arguments.alias("arguments"))
    calls = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), F.array(call(F.concat(F.lit("run"), turn), F.col("text")), call(F.lit("stop"), F.lit(None).cast("string"))))
    rows = m.withColumns({"tool_call_id": F.when(F.col("turn") % 2 == 0, F.concat(F.lit("call_"), turn)), "tool_calls": calls})
    return history.history_text(rows).select("conv_id", F.md5(F.col("history").cast("binary")).alias("digest"))


@query("""WITH l AS (SELECT n_regionkey AS r, CASE n_nationkey % 5 WHEN 0 THEN '| ' || n_name || ' | ' || n_nationkey || ' |' WHEN 1 THEN '|---|:---:| |' WHEN 2 THEN n_name || '|x' WHEN 3 THEN '|--|---|' ELSE '| a | | ' || n_name || ' | d |' END AS line, n_nationkey AS k FROM nation),
c AS (SELECT r, k, list_transform(string_split(regexp_replace(regexp_replace(trim(line), '^\\|', ''), '\\|$', ''), '|'), lambda x: trim(x)) AS cells FROM l),
w AS (SELECT *, max(len(cells)) OVER (PARTITION BY r) AS most FROM c)
SELECT r AS region, (row_number() OVER (PARTITION BY r ORDER BY k) - 1)::INT AS pos, len(list_filter(cells, lambda x: x <> '' AND NOT regexp_matches(x, '^:?-{3,}:?$'))) = 0 AS separator, array_to_string(cells, ';') || repeat(';', (most - len(cells))::INT) AS cells FROM w""")
def markdown_tables(spark, sf):
    """Every region's nations as the lines of a table: rows and separators with and without outer pipes, of different lengths."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    line = F.when(k % 5 == 0, F.concat(F.lit("| "), name, F.lit(" | "), k.cast("string"), F.lit(" |"))).when(k % 5 == 1, "|---|:---:| |").when(k % 5 == 2, F.concat(name, F.lit("|x"))).when(k % 5 == 3, "|--|---|").otherwise(F.concat(F.lit("| a | | "), name, F.lit(" | d |")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("l")))), lambda x: x["l"])
    rows = read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(lines.alias("lines"))
    rows = rows.select("region", F.posexplode(T.table_rows(F.col("lines"))).alias("pos", "_r"))
    return rows.select("region", "pos", F.col("_r.separator").alias("separator"), F.array_join("_r.cells", ";").alias("cells"))


@query("""WITH u AS (SELECT page_id AS p, CASE page_id % 7 WHEN 0 THEN ' https://github.com/o/r/tree/main/a/b' WHEN 1 THEN 'gh:o/r' || page_id WHEN 2 THEN 'https://github.com/o/r' WHEN 3 THEN 'git@host:o/r' WHEN 4 THEN url || '/SKILL.md' WHEN 5 THEN 'https://github.com/o/r/raw/SKILL.md' ELSE url || '//' END AS u, url FROM pages)
SELECT p AS page_id, CASE WHEN p % 7 IN (1, 2, 3) THEN 'git' ELSE 'raw' END AS kind, CASE p % 7 WHEN 0 THEN 'https://raw.githubusercontent.com/o/r/main/a/b/SKILL.md' WHEN 1 THEN 'https://github.com/o/r' || p || '.git' WHEN 6 THEN rtrim(url, '/') || '/SKILL.md' ELSE u END AS source FROM u""")
def install_sources(spark, sf):
    i, url = F.col("page_id"), F.col("url")
    kinds = [F.lit(" https://github.com/o/r/tree/main/a/b"), F.concat(F.lit("gh:o/r"), i.cast("string")), F.lit("https://github.com/o/r"), F.lit("git@host:o/r"), F.concat(url, F.lit("/SKILL.md")), F.lit("https://github.com/o/r/raw/SKILL.md"), F.concat(url, F.lit("//"))]
    return read(spark, sf, "pages").select("page_id", T.install_source(F.get(F.array(*kinds), (i % 7).cast("int"))).alias("s")).select("page_id", "s.kind", F.col("s.url").alias("source"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS due, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
a AS (SELECT user_id, event_id, due, n, due AS admitted, [due] AS recent FROM e WHERE n = 1 UNION ALL
  SELECT user_id, event_id, due, n, t AS admitted, list_append(list_filter(recent, lambda x: t - x < 86400), t)[-3:] AS recent FROM (
    SELECT user_id, event_id, due, n, recent, CASE WHEN len(recent) >= 3 THEN greatest(t, recent[1] + 90000) ELSE t END AS t FROM (
      SELECT e.user_id, e.event_id, e.due, e.n, greatest(e.due, a.recent[-1]) AS t, list_filter(a.recent, lambda x: greatest(e.due, a.recent[-1]) - x < 86400) AS recent FROM a JOIN e ON e.user_id = a.user_id AND e.n = a.n + 1)))
SELECT user_id, event_id, round(admitted, 3) AS admitted FROM a""")
def expiring_admission(spark, sf):
    """Three events a day each user, admitted over several runs of a stream that forgets users once nothing of theirs counts."""
    from weftline.plans.live_queries import lots, run

    folder = scratch(spark)
    rows = read(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), F.col("ts").cast("timestamp").alias("ts"))
    for lot in lots(rows, "ts"):
        lot.drop("ts").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.drop("ts").schema).parquet(f"{folder}/in")
        run(limits.admit(stream, seconds=86_400, pause=90_000, lateness="0 seconds"), folder)
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_id", F.round("admitted", 3).alias("admitted"))
