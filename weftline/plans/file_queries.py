"""Files, edits, code, configuration, streams: texts and folders derived from the tables by a stated mapping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import batch, build, catalog, code, edits, match, search, tasks, trail
from weftline.plans.registry import query, read, scratch, wide
from weftline.plans.sqltext import bm25, tokens
from weftline.plans.store_queries import _TASKS, task_table
from weftline.sources import files, paged
from weftline.streaming import deltas, index, limits


def text(c: str):
    return F.col(c).cast("string")


# Calls


@query("SELECT event_id, list_extract(['read', 'glob', 'grep', 'question', 'webfetch', 'websearch', 'skill', 'skills', 'invalid', 'fact_read', 'episodic_search', 'parallel_execute', 'write', 'bash', 'edit'], (event_id % 15 + 1)::INT) AS call, event_id % 15 < 12 AS read_only FROM events")
def read_only_names(spark, sf):
    names = ["read", "glob", "grep", "question", "webfetch", "websearch", "skill", "skills", "invalid", "fact_read", "episodic_search", "parallel_execute", "write", "bash", "edit"]
    rows = read(spark, sf, "events").select("event_id", F.get(F.array(*map(F.lit, names)), (F.col("event_id") % 15).cast("int")).alias("call"))
    return rows.withColumn("read_only", F.col("call").isin(*catalog.READ_ONLY))


@query("""WITH c AS (SELECT user_id * 100000 + n // 6 AS round, n AS seq, event_type || CASE WHEN event_type = 'view' THEN event_id % 2 ELSE 0 END AS what, event_type AS name
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)),
l AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY seq DESC) AS back FROM c)
SELECT round, max(name) AS name FROM l WHERE back <= 3 GROUP BY round HAVING count(*) = 3 AND count(DISTINCT what) = 1""")
def repeat_calls_nested(spark, sf):
    rows = read(spark, sf, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    t, odd = F.col("event_type"), F.col("event_id") % 2 == 1
    number = F.when((t == "view") & odd, '"1"').otherwise("1")  # a number isn't its string
    one = F.concat(F.lit('{"a": {"x": '), number, F.lit(', "y": "'), t, F.lit('"}, "l": [1, 2]}'))
    two = F.concat(F.lit('{"l":[1,2],"a":{"y":"'), t, F.lit('","x":'), number, F.lit("}}"))
    calls = rows.select((F.col("user_id") * 100000 + F.floor(F.col("n") / 6)).alias("round"), F.col("n").alias("seq"), t.alias("name"), F.when(odd, one).otherwise(two).alias("args"))
    return trail.repeat_alerts(calls)


@query("SELECT event_id, CASE WHEN event_id % 7 < 6 THEN 'context_overflow' ELSE 'http_400' END AS kind FROM events")
def error_phrases(spark, sf):
    said = ["This: context_length_exceeded.", "over the Context Window", "PROMPT IS TOO LONG: 9", "maximum context length is 8", "please reduce the length of it", "Too many tokens", "bad request"]
    return read(spark, sf, "events").select("event_id", T.classify_error(F.lit(400), F.get(F.array(*map(F.lit, said)), (F.col("event_id") % 7).cast("int"))).alias("kind"))


@query("""SELECT user_id AS round, event_id AS pos, event_type AS name, CASE WHEN rank > 10 THEN 'over' WHEN event_type = 'view' THEN 'refused' WHEN event_type = 'click' THEN 'ok' WHEN event_type = 'purchase' THEN 'error' ELSE 'unknown' END AS outcome,
CASE WHEN rank > 10 THEN NULL WHEN event_type = 'click' THEN 'got ' || event_id WHEN event_type = 'purchase' THEN 'ValueError: no ' || event_id END AS answer
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events)""")
def ordered_batch(spark, sf):
    def fails(args):
        raise ValueError(f"no {args}")

    requests = read(spark, sf, "events").select(F.col("user_id").alias("round"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"), text("event_id").alias("args"))
    names = [r["name"] for r in requests.select("name").distinct().collect() if r["name"] != "view"]  # a handful of kinds
    return batch.run_batch(requests, {"click": lambda a: f"got {a}", "purchase": fails}, allowed=tuple(names))


@query("SELECT user_id, event_id AS pos, event_id AS id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS answer FROM events")
def restored_order(spark, sf):
    e = read(spark, sf, "events")
    answers = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("answer")).orderBy(F.xxhash64("id"))
    return batch.in_order(answers, e.select("user_id", F.col("event_id").alias("pos"), F.col("event_id").alias("id")), "user_id", "pos")


# Sessions, tasks, configuration


@query("SELECT conv_id, max(turn) * 37 % 11 AS mtime FROM conversations GROUP BY conv_id")
def sessions_by_time(spark, sf):
    return catalog.sorted_sessions(read(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") * 37 % 11).alias("mtime")))


@query("SELECT conv_id, max(turn) * 37 % 11 AS mtime, (conv_id % 4)::DOUBLE AS score FROM conversations WHERE conv_id % 4 > 0 GROUP BY conv_id")
def sessions_by_score(spark, sf):
    sessions = read(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") * 37 % 11).alias("mtime"))
    return catalog.sorted_sessions(sessions, sessions.select("conv_id", (F.col("conv_id") % 4).cast("double").alias("score")))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example')")
def path_filter(spark, sf):
    return edits.containing(read(spark, sf, "pages").select("page_id", "url"), "EXAMPLE", "url")


@query("SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def session_export(spark, sf):
    return files.export_session(read(spark, sf, "conversations"))


@query("SELECT conv_id || ' ' || turn || ' ' || role AS value FROM conversations UNION ALL SELECT 'end' FROM conversations WHERE turn = 0")
def session_log(spark, sf):
    folder, c = scratch(spark), read(spark, sf, "conversations")
    files.append_log(c.select(F.concat_ws(" ", text("conv_id"), text("turn"), "role").alias("line")), folder)
    files.append_log(c.where("turn = 0").select(F.lit("end").alias("line")), folder)
    return spark.read.text(folder)


@query("SELECT c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS model FROM customer WHERE c_custkey % 5 <> 0")
def preset_store(spark, sf):
    folder, c = scratch(spark), read(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("model"))
    files.save_presets(c, folder)
    files.save_presets(c.where("name % 3 = 0").withColumn("model", F.lit("new")), folder)
    files.delete_presets(c.where("name % 5 = 0"), folder)
    return files.read_presets(spark, folder)


@query("""SELECT c_custkey::VARCHAR AS name, CASE WHEN c_custkey % 7 = 4 THEN 'moved' ELSE c_mktsegment END AS url, c_acctbal > 0 AS enabled, CASE c_custkey % 7 WHEN 1 THEN 'duplicate' WHEN 4 THEN 'modified' ELSE 'kept' END AS outcome FROM customer WHERE c_custkey % 7 <> 3
UNION ALL SELECT 'n' || c_custkey, 'fresh', true, 'added' FROM customer WHERE c_custkey % 7 = 1 UNION ALL SELECT 'x' || c_custkey, NULL, NULL, 'missing' FROM customer WHERE c_custkey % 7 = 3""")
def config_changes(spark, sf):
    key, k = F.col("c_custkey").cast("string"), F.col("c_custkey") % 7
    c = read(spark, sf, "customer")
    config = c.select(key.alias("name"), F.col("c_mktsegment").alias("url"), (F.col("c_acctbal") > 0).alias("enabled"))
    none = F.lit(None).cast("boolean")
    change = lambda where, name, action, url, on: c.where(where).select(name.alias("name"), F.lit(action).alias("action"), F.lit(url).cast("string").alias("url"), on.alias("enabled"))
    changes = change(k == 1, key, "add", "other", none).unionByName(change(k == 1, F.concat(F.lit("n"), key), "add", "fresh", F.lit(True)))
    changes = changes.unionByName(change(k == 3, key, "remove", None, none)).unionByName(change(k == 3, F.concat(F.lit("x"), key), "remove", None, none)).unionByName(change(k == 4, key, "modify", "moved", none))
    return catalog.change_config(config, changes)


@query(f"SELECT id, 'agent' AS role, agent AS name FROM ({_TASKS}) WHERE agent NOT IN ('a0', 'a2') UNION ALL SELECT id, 'reviewer', reviewer_agent FROM ({_TASKS}) WHERE reviewer_agent IS NOT NULL")
def unknown_agents(spark, sf):
    return tasks.unknown_agents(task_table(spark, sf), spark.createDataFrame([("a0",), ("a2",)], "name string"))


@query("SELECT user_id, seen IS NULL OR epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(seen) > 120000000 AS stale FROM (SELECT user_id, max(ts) FILTER (WHERE event_type = 'view') AS seen FROM events GROUP BY user_id)")
def heartbeat_staleness(spark, sf):
    beats = read(spark, sf, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("at"))
    return catalog.stale(beats, F.expr("TIMESTAMP '2024-01-20 00:00:00'")).select("user_id", "stale")


@query("SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN printf('$%.2f', (p_size % 3) * 0.25) END AS price FROM part")
def model_price(spark, sf):
    part = F.col("p_size") % 3
    return read(spark, sf, "part").select("p_partkey", T.format_price((part * 0.000000125).cast("string"), F.when(part > 0, (part * 0.000000125).cast("string")).otherwise("n/a")).alias("price"))


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'a')")
def models_without_params(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(None).cast("array<string>").alias("supported_parameters"))
    return catalog.supporting(rows.withColumn("id", text("id")), ["tools"], "A").select(F.col("id").cast("long").alias("id"))


@query("""SELECT 'skill' || n_nationkey AS folder, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'skill' || n_nationkey END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'does ' || n_name ELSE substr('Body of ' || n_name || ' ' || repeat('x', 100), 1, 80) END AS description,
'Body of ' || n_name || ' ' || repeat('x', 100) AS doc FROM nation WHERE n_nationkey % 5 <> 4""")
def markdown_functions(spark, sf):
    n = F.col("n_nationkey")
    body = F.concat(F.lit("Body of "), "n_name", F.lit(" "), F.repeat(F.lit("x"), F.lit(100)))
    head = F.concat(F.lit("---\n# comment: no\nversion: 1\nname: first\nname: "), F.when(n % 2 == 0, F.concat(F.lit("'"), "n_name", F.lit("'"))).otherwise(""), F.when(n % 3 == 0, F.concat(F.lit("\ndescription: does "), "n_name")).otherwise(""), F.lit("\n---\n"))
    folder = F.concat(F.when(n % 5 == 4, "_").otherwise(""), F.lit("skill"), text("n_nationkey"))
    return T.markdown_functions(read(spark, sf, "nation").select(F.concat(F.lit("skills/"), folder, F.lit("/SKILL.md")).alias("path"), F.concat(head, body).alias("text")))


@query("""SELECT 'n' || c_nationkey AS listing, (n // 4)::INT AS page, (n % 4)::INT AS pos, '{"id": ' || c_custkey || ', "name": "' || c_name || '"}' AS item
FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)""")
def paged_listings(spark, sf):
    """Customers as listings by nation, in page files of four that tasks write and follow by their cursors."""
    folder = scratch(spark)
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    item = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    paged.write_pages(read(spark, sf, "customer").select(F.concat(F.lit("n"), text("c_nationkey")).alias("listing"), place.alias("pos"), item.alias("item")), folder, 4)
    names = [f"n{r[0]}" for r in read(spark, sf, "customer").select("c_nationkey").distinct().collect()]
    return paged.read_listings(spark, names, paged.stored_pages(folder))


@query("""WITH u AS (SELECT page_id, list_slice(regexp_extract_all(html, '(?s)<a[^>]+href=[''"]([^''"]+)[''"][^>]*>(.*?)</a>', 1), 1, 2) AS us, list_slice(regexp_extract_all(html, '(?s)<a[^>]+href=[''"]([^''"]+)[''"][^>]*>(.*?)</a>', 2), 1, 2) AS ts FROM pages),
x AS (SELECT page_id, unnest(us) AS u, trim(regexp_replace(unnest(ts), '<[^>]+>', '', 'g')) AS title FROM u)
SELECT page_id, replace(u, '&amp;', '&') AS url, title FROM x WHERE title <> '' AND lower(title) <> 'more info'""")
def first_results(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.inline(T.result_links(F.col("html"), 2)))


# Files, edits


@query("SELECT 'd/' || n_name || ' ' || n_nationkey || '.txt' AS path, 'a' || chr(10) || n_name || chr(10) AS text FROM nation")
def text_store(spark, sf):
    folder = scratch(spark)
    rows = read(spark, sf, "nation").select(F.concat(F.lit("d/"), "n_name", F.lit(" "), text("n_nationkey"), F.lit(".txt")).alias("path"), F.concat(F.lit("a\n"), "n_name", F.lit("\n")).alias("text"))
    files.write_texts(rows, folder)
    return files.read_texts(spark, folder)


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'a' || chr(65533) || 'b' ELSE c_name END AS text FROM customer")
def invalid_bytes(spark, sf):
    bad = F.concat(F.lit("a").cast("binary"), F.unhex(F.lit("FF")), F.lit("b").cast("binary"))
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), files.text_of(F.when(F.col("c_custkey") % 2 == 0, bad).otherwise(F.col("c_name").cast("binary"))).alias("text"))


@query("SELECT store, line_no, CASE WHEN store = '1' AND line_no = 2 THEN '- likes 41' ELSE line END AS line FROM (SELECT (c_custkey // 40)::VARCHAR AS store, (c_custkey % 40 + 1)::INT AS line_no, CASE WHEN c_custkey % 10 = 0 THEN '# heading' WHEN c_custkey % 4 = 0 THEN '<!-- note -->' ELSE '- likes ' || c_custkey END AS line FROM customer) UNION ALL SELECT '2', 41, '- note' UNION ALL SELECT '2', 42, '<!-- added 2024-01-02 03:04:05 -->'")
def fact_upsert_cases(spark, sf):
    """What only a comment holds is added with its time; a replacement counts without what it replaces; a full store stays."""
    from weftline.plans.store_queries import every_fact

    facts = edits.upsert_fact(every_fact(spark, sf), "2", "note", now=F.expr("TIMESTAMP '2024-01-02 03:04:05'"))
    size = facts.where("store = '1'").agg((F.sum(F.length("line") + 1) - 1).alias("n")).first()["n"]
    facts = edits.upsert_fact(facts, "1", "likes 41", limit=size)
    return edits.upsert_fact(facts, "1", "is too much", limit=size)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'ok' WHEN n_nationkey % 3 = 1 THEN 'missing' ELSE 'ambiguous' END AS outcome, CASE n_nationkey % 3 WHEN 0 THEN '1: one' || chr(10) || '2: TWO ' || n_name || chr(10) || '3: three' || chr(10) || '4: four' || chr(10) || '5: five' || chr(10) || '6: six' WHEN 1 THEN '' ELSE 'near line 2' || chr(10) || '1: one' || chr(10) || '2: two ' || n_name || chr(10) || '3: two' || chr(10) || 'near line 3' || chr(10) || '2: two ' || n_name || chr(10) || '3: two' || chr(10) || '4: four' END AS report FROM nation")
def edit_reports(spark, sf):
    k = F.col("n_nationkey") % 3
    body = F.concat(F.lit("one\n"), F.when(k == 1, "2 ").otherwise("two "), "n_name", F.lit("\n"), F.when(k == 2, "two").otherwise("three"), F.lit("\nfour\nfive\nsix\nseven"))
    return edits.edit_report(read(spark, sf, "nation").select("n_nationkey", body.alias("text")), "two", "TWO").select("n_nationkey", "outcome", "report")


@query("""WITH p AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, html FROM pages), m AS (SELECT path, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM (SELECT path, string_split(html, chr(10)) AS ls FROM p WHERE regexp_matches(path, '(^|/)[^/]*[0-9]$'))),
h AS (SELECT path || ':' || i || ':' || substr(l, 1, 200) AS shown, row_number() OVER (ORDER BY path, i) AS r FROM m WHERE contains(l, '<p'))
SELECT shown FROM h WHERE r <= 20 UNION ALL SELECT '... (' || count(*) - 20 || ' more matches)' FROM h HAVING count(*) > 20""")
def grep_more(spark, sf):
    rows = read(spark, sf, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.col("html").alias("text"))
    return edits.grep_lines(rows, "<p", most=20, include="*[0-9]").select("shown")


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT doc_id, len(ls) AS total, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM d),
u AS (SELECT doc_id, total, i, sum(len(i || ': ' || x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM l WHERE i >= 3 AND i < 23), last AS (SELECT doc_id, max(i) FILTER (WHERE used <= 1500) AS last FROM u GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(last, 2) < len(ls) THEN '(Showing lines 3-' || coalesce(last, 2) || ' of ' || len(ls) || '. Use offset=' || coalesce(last, 2) + 1 || ' to continue.)' ELSE '(End of file - total ' || len(ls) || ' lines)' END AS marker FROM d LEFT JOIN last USING (doc_id)""")
def read_markers(spark, sf):
    return edits.read_marker(read(spark, sf, "documents"), 3, 20, 1500)


@query("""WITH p AS (SELECT DISTINCT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) || CASE WHEN contains(regexp_replace(url, '^[a-z]+://', ''), '/') THEN '/' ELSE '' END AS name FROM pages)
SELECT pos::INT AS pos, name, total FROM (SELECT name, row_number() OVER (ORDER BY name) AS pos, count(*) OVER () AS total FROM p) WHERE pos BETWEEN 2 AND 6""")
def folder_listing(spark, sf):
    return edits.list_folder(read(spark, sf, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")), offset=2, limit=5)


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'a.txt' ELSE 'b.txt' END AS path, CASE WHEN p_partkey % 3 = 0 THEN 'head' || chr(10) || 'size: ' || CASE WHEN p_partkey % 2 = 0 THEN 'small' ELSE p_size::VARCHAR END || chr(10) || 'end' ELSE 'head' || chr(10) || 'size ' || p_size || chr(10) || 'tail' END AS patched, CASE WHEN p_partkey % 3 <> 0 THEN 0 WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS applied, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 1 ELSE 0 END AS failed FROM part")
def patched_files(spark, sf):
    patch = "--- a.txt\n+++ a.txt\n@@ -1 +1 @@\n-size \n+size: \n@@ -2 +2 @@\n-x\n-tail\n+small\n+end\n".replace("-size \n+size: \n", "-tail\n+end\n").replace("-x\n-tail\n+small\n+end\n", "-size even\n+size: small\n")
    k = F.col("p_partkey")
    size = F.when((k % 3 == 0) & (k % 2 == 0), F.lit("size even")).when(k % 3 == 0, F.concat(F.lit("size: "), text("p_size"))).otherwise(F.concat(F.lit("size "), text("p_size")))
    rows = read(spark, sf, "part").select(k.alias("k"), F.when(k % 3 == 0, "a.txt").otherwise("b.txt").alias("path"), F.concat(F.lit("head\n"), size, F.lit("\ntail")).alias("text"))
    return code.apply_patch(rows, patch).select("k", "path", "patched", "applied", "failed")


_SOURCES = {
    "py": "import os\nfrom a.b import c\n\ndef f{k}(x):\n    return g(x)\n\nclass C{k}:\n    def m(self):\n        return {k}\n",
    "go": "package p{k}\n\nfunc F{k}(a int) int {{\n\tb := a\n\treturn b\n}}\n",
    "rs": "struct S{k} {{\n    a: i32,\n    b: i32,\n}}\n\nimpl S{k} {{\n    fn m{k}() {{\n        one();\n        two();\n    }}\n}}\n",
    "js": "class A{k} {{\n  one() {{}}\n  two() {{}}\n}}\n\nfunction f{k}() {{\n  a();\n  b();\n}}\n",
}


def _sources(spark, sf):
    """A source file a part, of one of four languages."""
    k, ends = F.col("p_partkey"), list(_SOURCES)
    bodies = F.array(*[F.replace(F.replace(F.replace(F.lit(t), F.lit("{k}"), text("p_partkey")), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")) for t in _SOURCES.values()])
    at = (k % 4).cast("int")
    return read(spark, sf, "part").select(F.concat(F.lit("src/f"), text("p_partkey"), F.lit("."), F.get(F.array(*map(F.lit, ends)), at)).alias("path"), F.get(bodies, at).alias("text"))


@query("""WITH p AS (SELECT p_partkey AS k FROM part)
SELECT 'src/f' || k || '.py' AS path, 4 AS start, 5 AS "end", 'function' AS type, 'f' || k AS name, 'a.b,os' AS imports, 'f' || k || ',g' AS symbols, 'python' AS lang FROM p WHERE k % 4 = 0
UNION ALL SELECT 'src/f' || k || '.py', 1, 3, 'module', '', 'a.b,os', '', 'python' FROM p WHERE k % 4 = 0
UNION ALL SELECT 'src/f' || k || '.py', 7, 9, 'class', 'C' || k, 'a.b,os', 'm', 'python' FROM p WHERE k % 4 = 0""")
def chunk_python(spark, sf):
    rows = code.chunk_code(_sources(spark, sf).where(F.col("path").endswith(".py")))
    return rows.select("path", "start", "end", "type", "name", F.array_join("imports", ",").alias("imports"), F.array_join("symbols", ",").alias("symbols"), "lang")


@query("""WITH p AS (SELECT p_partkey AS k FROM part)
SELECT 'src/f' || k || '.rs' AS path, 'struct' AS type, 'S' || k AS name, 'rust' AS lang FROM p WHERE k % 4 = 2
UNION ALL SELECT 'src/f' || k || '.rs', 'impl', 'S' || k, 'rust' FROM p WHERE k % 4 = 2
UNION ALL SELECT 'src/f' || k || '.rs', 'method', 'm' || k, 'rust' FROM p WHERE k % 4 = 2
UNION ALL SELECT 'src/f' || k || '.js', 'class', 'A' || k, 'javascript' FROM p WHERE k % 4 = 3
UNION ALL SELECT 'src/f' || k || '.js', 'function', 'f' || k, 'javascript' FROM p WHERE k % 4 = 3""")
def chunk_braces(spark, sf):
    rows = code.chunk_code(_sources(spark, sf).where(F.col("path").rlike(r"\.(rs|js)$")))
    return rows.select("path", "type", "name", "lang")


@query("SELECT 'src/f' || p_partkey || '.go' AS path, 'function' AS type, 'F' || p_partkey AS name, 'func F' || p_partkey || '(a int) int {' || chr(10) || chr(9) || 'b := a' || chr(10) || chr(9) || 'return b' || chr(10) || '}' AS text FROM part WHERE p_partkey % 4 = 1")
def chunk_go(spark, sf):
    rows = code.chunk_code(_sources(spark, sf).where(F.col("path").endswith(".go")))
    return rows.where("type = 'function'").select("path", "type", "name", F.regexp_replace("text", r"\s+\z", "").alias("text"))


@query("SELECT n_regionkey AS region, 0 AS at, max(len(n_name))::INT AS width FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 1, max(2 * (n_nationkey % 5) + 1)::INT FROM nation GROUP BY 1")
def table_widths(spark, sf):
    cells = F.array("n_name", F.concat(F.repeat(F.lit("漢"), (F.col("n_nationkey") % 5).cast("int")), F.lit("é")))
    return code.column_widths(read(spark, sf, "nation").withColumnRenamed("n_regionkey", "region"), cells, "region")


# Indexes and stores


@query(f"WITH {bm25(['reinheon', 'thanoned', 'atoust'])} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 5")
def stored_search(spark, sf):
    folder = scratch(spark)
    search.save(wide(spark, sf, "documents"), folder)
    posted, sizes, stats = search.load(spark, folder)
    return search.top_k(search.scores(posted, sizes, stats, ["reinheon", "thanoned", "atoust"]), 5).select("doc_id", F.round("score", 6).alias("score"))


_MATCH = """WITH m AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM conversations),
f AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'that')) AS a, len(list_filter(w, lambda x: x = 'with')) AS b, len(list_filter(w, lambda x: starts_with(x, 'fro'))) AS c, len(list_filter(range(1, len(w)), lambda i: w[i] = 'in' AND w[i + 1] = 'that')) AS d FROM m),
s AS (SELECT count(*) AS n, avg(n) AS av, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db, count(*) FILTER (WHERE c > 0) AS dc FROM f),
x AS (SELECT id, greatest(ln((s.n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * f.n / av)) + greatest(ln((s.n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * f.n / av)) + greatest(ln((s.n - dc + 0.5) / (dc + 0.5)), 1e-6) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * f.n / av)) AS score
  FROM f, s WHERE a > 0 AND (b > 0 OR c > 0) AND NOT d > 0)
SELECT id, round(score, 6) AS score FROM x ORDER BY x.score DESC, id LIMIT 10"""


@query(_MATCH)
def match_grammar(spark, sf):
    m = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return match.match(m, 'That (with OR fro*) NOT "in that"').select("id", F.round("score", 6).alias("score"))


@query("""WITH g AS (SELECT r_regionkey AS k FROM region UNION ALL SELECT r_regionkey + 5 FROM region),
j AS (SELECT n_regionkey AS k, '[' || string_agg('{"name":"' || n_name || '","score":' || (n_nationkey + 0.5)::DOUBLE || '}', ',' ORDER BY n_nationkey DESC) || ']' AS json FROM nation GROUP BY 1)
SELECT k, coalesce(json, '[]') AS json FROM g LEFT JOIN j USING (k)""")
def result_json(spark, sf):
    """Every region's nations as results, and as many groups without any."""
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    found = search.to_json(n.select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 0.5).cast("double").alias("score")), by="k")
    groups = r.select(F.explode(F.array("r_regionkey", F.col("r_regionkey") + 5)).alias("k"))
    return groups.join(found, "k", "left").select("k", F.coalesce("json", F.lit("[]")).alias("json"))


@query("SELECT 'src/' || n_nationkey || '.md' AS path, 'section' AS type, n_name AS name FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'src/' || n_nationkey || '.py', 'function', 'f' || n_nationkey FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT 'src/' || n_nationkey || '.txt', 'paragraph', '' FROM nation WHERE n_nationkey % 3 = 2")
def files_to_chunks(spark, sf):
    n, k = read(spark, sf, "nation"), F.col("n_nationkey")
    kind = F.get(F.array(F.lit(".md"), F.lit(".py"), F.lit(".txt")), (k % 3).cast("int"))
    body = F.when(k % 3 == 0, F.concat(F.lit("# "), "n_name", F.lit("\nabout it\nand more"))).when(k % 3 == 1, F.concat(F.lit("def f"), text("n_nationkey"), F.lit("():\n    return 1\n"))).otherwise(F.concat("n_name", F.lit(" has a paragraph of well over fifty bytes of text in it")))
    return build.chunk_files(n.select(F.concat(F.lit("src/"), text("n_nationkey"), kind).alias("path"), body.alias("text"))).select("path", "type", "name")


@query(f"SELECT id::VARCHAR AS id, status, retries FROM ({_TASKS})")
def task_store(spark, sf):
    folder = scratch(spark)
    t = task_table(spark, sf).select(text("id").alias("id"), "status", "retries")
    files.write_tasks(t, folder)
    return files.read_tasks(spark, folder).select("id", "status", "retries")


# Streams


def _streamed(spark, rows):
    """The rows again, as a stream of files."""
    folder = scratch(spark)
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


@query(f"WITH m AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE coalesce(text, '') <> ''), {tokens('m', 'id')} SELECT term, id, count(*)::BIGINT AS tf FROM token GROUP BY ALL")
def followed_index(spark, sf):
    folder = scratch(spark)
    m = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), text("conv_id").alias("session_id"), "text")
    index.follow(_streamed(spark, m), f"{folder}/index", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/index/postings").select("term", "id", F.col("tf").cast("long").alias("tf"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, (event_id % 40)::DOUBLE AS due, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 40, event_id) AS n FROM events),
a AS (SELECT user_id, event_id, due, n, due AS admitted, [due] AS recent FROM e WHERE n = 1 UNION ALL
  SELECT user_id, event_id, due, n, t AS admitted, list_append(list_filter(recent, lambda x: t - x < 54), t)[-3:] AS recent FROM (
    SELECT user_id, event_id, due, n, recent, CASE WHEN len(recent) >= 3 THEN greatest(t, recent[1] + 60) ELSE t END AS t FROM (
      SELECT e.user_id, e.event_id, e.due, e.n, greatest(e.due, a.recent[-1]) AS t, list_filter(a.recent, lambda x: greatest(e.due, a.recent[-1]) - x < 54) AS recent FROM a JOIN e ON e.user_id = a.user_id AND e.n = a.n + 1)))
SELECT user_id, event_id, due AS "at", admitted FROM a""")
def admitted_stream(spark, sf):
    folder = scratch(spark)
    rows = read(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 40).cast("double").alias("at"))
    stream = limits.admit(_streamed(spark, rows.coalesce(1)))
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def block_lines(spark, sf):
    """Events as lines of content blocks, one stream a user: text, the start of a tool call and its arguments, usage."""
    e, i = read(spark, sf, "events"), text("event_id")
    said = F.concat(F.lit('data: {"type":"content_block_delta","index":0,"delta":{"type":"text_delta","text":"'), "event_type", F.lit(' "}}'))
    begun = F.concat(F.lit('data: {"type":"content_block_start","index":1,"content_block":{"type":"tool_use","id":"c'), i, F.lit('","name":"'), F.when(F.col("event_id") % 12 == 1, "run").otherwise(""), F.lit('"}}'))
    part = F.concat(F.lit('data: {"type":"content_block_delta","index":1,"delta":{"type":"input_json_delta","partial_json":"'), i, F.lit(';"}}'))
    used = F.concat(F.lit('data: {"type":"message_delta","delta":{"stop_reason":"end_turn","usage":{"input_tokens":7,"output_tokens":'), i, F.lit("}}}"))
    k = F.col("event_id") % 4
    return e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.when(k == 0, said).when(k == 1, begun).when(k == 2, part).otherwise(used).alias("line"))


@query("""SELECT user_id AS stream_id, coalesce(string_agg(event_type || ' ', '' ORDER BY event_id) FILTER (WHERE event_id % 4 = 0), '') AS content, CASE WHEN bool_or(event_id % 4 = 3) THEN 7 ELSE 0 END::BIGINT AS prompt_tokens,
coalesce(max(event_id) FILTER (WHERE event_id % 4 = 3), count(*) FILTER (WHERE event_id % 4 = 0))::BIGINT AS completion_tokens, coalesce(max(event_id) FILTER (WHERE event_id % 4 = 3) + 7, 0)::BIGINT AS total_tokens FROM events GROUP BY user_id""")
def fold_block_deltas(spark, sf):
    folded = deltas.fold_messages(deltas.parse_blocks(block_lines(spark, sf)))
    return folded.select("stream_id", "content", "prompt_tokens", "completion_tokens", "total_tokens")


@query("""SELECT user_id AS stream_id, 'c' || max(event_id) FILTER (WHERE event_id % 4 = 1) AS id, string_agg('run', '') FILTER (WHERE event_id % 12 = 1) AS name, coalesce(string_agg(event_id || ';', '' ORDER BY event_id) FILTER (WHERE event_id % 4 = 2), '') AS arguments
FROM events GROUP BY user_id HAVING bool_or(event_id % 12 = 1)""")
def fold_block_calls(spark, sf):
    return deltas.fold_calls(deltas.parse_blocks(block_lines(spark, sf))).select("stream_id", "id", "name", "arguments")


@query("SELECT user_id AS stream_id, NOT bool_or(event_id % 50 = 0) AS interrupted FROM events GROUP BY user_id")
def interrupted_streams(spark, sf):
    rows = read(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 == 0, "data: [DONE]").otherwise("data: {}").alias("line"))
    return deltas.interrupted(rows)
