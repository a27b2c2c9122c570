"""Nested front matter, functions with schemas, inline Markdown: files and calls derived from whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.frontmatter import front_matter
from weftline.functions.inline import inline_spans
from weftline.operators import tools
from weftline.plans.registry import query, read, wide


def matter(key):
    """Front matter with maps, lists, quotes, blocks and a flow value; every ninth is broken, every tenth has none."""
    k = F.col(key).cast("string")
    good = F.concat(
        F.lit("---\nname: f"), k, F.lit("\nweight: "), k, F.lit("\nready: "), F.when(F.col(key) % 2 == 0, "Yes").otherwise("off"),
        F.lit("\ntags:\n  - t"), (F.col(key) % 7).cast("string"), F.lit("\n  - \"a: b\"\nowner:\n  who: 'it''s "), k, F.lit("'\n  since: 2.5\nnote: |\n  line "), k, F.lit("\n    deeper\nfold: >-\n  one\n  two\nflow: {x: [1, "), k, F.lit("], y: null} # end\n---\nBody of "), k, F.lit("\n"),
    )
    bad = F.concat(F.lit("---\nname: \"f"), k, F.lit("\nweight: "), k, F.lit("\nready: yes\nodd: [1, 2\n---\nBody of "), k)
    return F.when(F.col(key) % 10 == 7, F.concat(F.lit("no marks "), k)).when(F.col(key) % 9 == 4, bad).otherwise(good)


@query("""SELECT c_custkey AS id, 'f' || c_custkey AS name, c_custkey AS weight, CASE WHEN b THEN true ELSE c_custkey % 2 = 0 END AS ready, CASE WHEN NOT b THEN 't' || (c_custkey % 7) || '|a: b' END AS tags,
CASE WHEN NOT b THEN 'it''s ' || c_custkey END AS who, CASE WHEN NOT b THEN 2.5::DOUBLE END AS since, CASE WHEN NOT b THEN 'line ' || c_custkey || chr(10) || '  deeper' || chr(10) END AS note, CASE WHEN NOT b THEN 'one two' END AS fold, CASE WHEN NOT b THEN c_custkey + 1 END AS flow_sum, NOT b AS parsed, 'Body of ' || c_custkey AS body
FROM (SELECT c_custkey, c_custkey % 9 = 4 AS b FROM customer WHERE c_custkey % 10 <> 7)""")
def nested_front_matter(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), front_matter(matter("c_custkey")).alias("m")).where(F.col("m.body").isNotNull())
    shape = "struct<name:string,weight:long,ready:boolean,tags:array<string>,owner:struct<who:string,since:double>,note:string,fold:string,flow:struct<x:array<long>>>"
    rows = rows.withColumn("f", F.from_json(F.regexp_replace("m.fields", r'("odd": )"[^"]*"', "$1null"), shape))
    total = F.aggregate("f.flow.x", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("id", "f.name", "f.weight", "f.ready", F.array_join("f.tags", "|").alias("tags"), "f.owner.who", "f.owner.since", "f.note", "f.fold", total.alias("flow_sum"), "m.parsed", "m.body")


#: The schema that every function file states, but for its name.
_SCHEMA = '{"type": "object", "properties": {"path": {"type": "string"}, "limit": {"type": "integer"}, "mode": {"type": "string", "enum": ["read", "write"]}, "deep": {"type": "boolean"}, "of": {"type": "array"}}, "required": ["path", "limit"]}'


def function_files(spark, sf):
    """A file for each nation: with a schema, with the default one, private, or without front matter."""
    k = F.col("n_nationkey")
    head = F.concat(F.lit("---\nname: "), "n_name", F.when(k % 3 == 0, F.concat(F.lit("\ndescription: about "), "n_name")).otherwise(""), F.when(k % 4 != 1, F.lit(f"\nschema: {_SCHEMA}")).otherwise(""), F.lit("\n---\n"))
    body = F.concat(F.lit("# "), "n_name", F.lit("\n\nText.\n\n## Dependencies\n- `pip install p"), k.cast("string"), F.lit("` - needed\n- tool"), k.cast("string"), F.lit(" - also\n* no bullet\n- \n\n## Notes\n- other"))
    path = F.concat(F.when(k % 11 == 5, "_").otherwise(""), F.lit("d"), k.cast("string"), F.lit("/SKILL.md"))
    return read(spark, sf, "nation").select(path.alias("path"), F.when(k % 11 == 6, body).otherwise(F.concat(head, body)).alias("text"))


_FUNCTIONS = """f AS (SELECT n_nationkey AS k, n_name AS n, n_nationkey % 4 <> 1 AS own FROM nation WHERE n_nationkey % 11 NOT IN (5, 6))"""


@query(f"""WITH {_FUNCTIONS} SELECT 'skill_' || n AS name, '[ONE-TIME] Load instructions for ''' || n || ''' skill. Call ONCE, then follow the instructions — do NOT call again. ' || CASE WHEN k % 3 = 0 THEN 'about ' || n ELSE substr('# ' || n || chr(10) || chr(10) || 'Text.' || chr(10) || chr(10) || '## Dependencies' || chr(10) || '- `pip install p' || k || '` - needed' || chr(10) || '- tool' || k || ' - also' || chr(10) || '* no bullet' || chr(10), 1, 80) END AS description,
CASE WHEN own THEN 'path,limit' ELSE 'input' END AS required, 'pip install p' || k || '|tool' || k AS needs FROM f""")
def offered_functions(spark, sf):
    f = tools.defined(function_files(spark, sf))
    needs = f.select(F.concat(F.lit("skill_"), "name").alias("name"), F.array_join(tools.dependencies(F.col("doc")), "|").alias("needs"))
    return tools.offered(f).join(needs, "name").select("name", "description", F.array_join("required", ",").alias("required"), "needs")


_CALLS = f"""WITH {_FUNCTIONS}, c AS (SELECT event_id AS id, event_id % 13 AS t, CASE WHEN event_id % 17 = 0 THEN 'nobody' ELSE (SELECT max(n_name) FROM nation WHERE n_nationkey = event_id % 25) END AS name FROM events),
j AS (SELECT c.*, f.n IS NOT NULL AS known, f.own FROM c LEFT JOIN f ON f.n = c.name)
SELECT id, name, CASE WHEN NOT known THEN 'no such function' WHEN t IN (1, 2) THEN 'not an object'
  WHEN own THEN list_extract(['', '', '', 'missing: limit;missing: path', 'missing: limit', 'not a string: path;not an integer: limit', 'unknown: colour', 'not one of its values: mode', 'not a boolean: deep;not an array: of', '', 'not an integer: limit', 'missing: limit;not a string: path', 'missing: limit;missing: path;unknown: input'], t::INT + 1)
  ELSE list_extract(['missing: input;unknown: limit;unknown: path', '', '', 'missing: input', 'missing: input;unknown: path', 'missing: input;unknown: limit;unknown: path', 'missing: input;unknown: colour;unknown: limit;unknown: path', 'missing: input;unknown: limit;unknown: mode;unknown: path', 'missing: input;unknown: deep;unknown: limit;unknown: of;unknown: path', 'missing: input;unknown: deep;unknown: limit;unknown: mode;unknown: of;unknown: path', 'missing: input;unknown: limit;unknown: path', 'missing: input;unknown: path', ''], t::INT + 1) END AS errors FROM j"""


@query(_CALLS)
def checked_calls(spark, sf):
    """Every event as a call of a nation's function: valid, without arguments, broken, missing, mistyped, unknown."""
    k, s = F.col("event_id"), lambda c: F.col(c).cast("string")
    arguments = F.get(
        F.array(
            F.concat(F.lit('{"path": "p'), s("event_id"), F.lit('", "limit": '), s("event_id"), F.lit("}")), F.lit("{not json"), F.lit("[1, 2]"), F.lit(None).cast("string"), F.lit('{"path": "x"}'), F.lit('{"path": 5, "limit": "five"}'),
            F.lit('{"path": "x", "limit": 1, "colour": "red"}'), F.lit('{"path": "x", "limit": 1, "mode": "append"}'), F.lit('{"path": "x", "limit": 1, "deep": "yes", "of": {"a": 1}}'), F.lit('{"path": "x", "limit": 1, "mode": "write", "deep": false, "of": [1]}'),
            F.lit('{"path": "x", "limit": 1.5}'), F.lit('{"path": null}'), F.lit('{"input": "x"}'),
        ), (k % 13).cast("int"),
    )
    names = read(spark, sf, "nation").select(F.col("n_nationkey").alias("_k"), "n_name")
    calls = read(spark, sf, "events").withColumn("_k", k % 25).join(names, "_k", "left").select(k.alias("id"), F.when(k % 17 == 0, "nobody").otherwise(F.col("n_name")).alias("name"), arguments.alias("arguments"))
    return tools.checked(calls, tools.defined(function_files(spark, sf))).select("id", "name", F.array_join("errors", ";").alias("errors"))


_MARKS = [("**", "**", "bold"), ("*", "*", "italic"), ("`", "`", "code"), ("~~", "~~", "strike"), ("[", "](to)", "link"), ("^", "^", "superscript"), ("__", "__", "bold"), ("_", "_", "italic"), ("~", "~", "subscript"), ("<SUP>", "</sup>", "superscript"), ("<sub>", "</sub>", "subscript"), ("", "", "")]


@query(f"""WITH w AS (SELECT conv_id * 1000 + turn AS id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '[^\\p{{L}}]+'), lambda x: x <> '') AS ws FROM conversations)),
m AS (SELECT id, i, w, list_extract({[a for a, _, _ in _MARKS]}, ((id + i) % 12 + 1)::INT) AS a, list_extract({[b for _, b, _ in _MARKS]}, ((id + i) % 12 + 1)::INT) AS b, list_extract({[c for _, _, c in _MARKS]}, ((id + i) % 12 + 1)::INT) AS kind FROM w),
p AS (SELECT *, coalesce(sum(length(a || w || b) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(a) AS start FROM m)
SELECT id, start::INT AS start, (start + length(w))::INT AS "end", kind FROM p WHERE kind <> ''""")
def inline_marks(spark, sf):
    """Every word of every message in marks of some kind, by its place."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}]+"), lambda x: x != "")
    rows = wide(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), words.alias("w"))
    side = lambda n: lambda i: F.get(F.array(*[F.lit(m[n]) for m in _MARKS]), ((F.col("id") + i + 1) % 12).cast("int"))
    text = F.array_join(F.transform("w", lambda x, i: F.concat(side(0)(i), x, side(1)(i))), " ")
    return rows.select("id", F.inline(inline_spans(text))).select("id", "start", "end", "kind")
