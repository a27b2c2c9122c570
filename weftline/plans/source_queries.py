"""Source files of many shapes, put together from the parts of a table; the SQL counts their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import code
from weftline.plans.registry import query, wide

#: Items of a Python file by kind: {j} is its place, {call} a line that is repeated by the file's key.
PYTHON = [
    "def f{j}(a):\n{call}",
    "async def a{j}():\n    def inner(b):\n        return h(b)\n    return inner(1)\n",
    "class C{j}:\n    v = 1\n    def m(self):\n        pass\n    async def n(self):\n        pass\n",
    "import os\nfrom a.b import c\n",
    "@deco\ndef d{j}():\n    pass\n",
]
RUST = [
    "pub fn f{j}(a: u32) -> u32 {\n{call}}\n",
    "struct S{j} {\n    a: u32,\n    b: u32,\n}\n",
    "impl S{j} {\n    fn m(&self) {\n        1;\n        2;\n    }\n}\n",
    "trait T{j} {\n    fn t(&self);\n    fn u(&self);\n}\n",
    "enum E{j} {\n    A,\n    B,\n}\nmod m{j} {\n    fn f() {\n        x\n    }\n}\n",
    "type X = u32;\n",
]


GO = [
    "func f{j}(a int) int {\n{call}}\n",
    "type S{j} struct {\n\tA int\n\tB string\n}\n",
    "type (\n\tI{j} interface {\n\t\tM()\n\t}\n\tK{j} int\n)\n",
    "func (s *S{j}) m(x int) {\n\treturn\n}\n",
    "var (\n\tx{j} = 1\n\ty{j} = \"}\"\n)\nconst c{j} = 2\n",
]
SCRIPT = [
    "function f{j}(a) {\n{call}}\n",
    "class C{j} {\n  async function m(a) {\n    1;\n    2;\n  }\n}\n",
    "const x = 1;\n",
    "function* h{j}(a) { return {\n  a: 1,\n  b: 2,\n}; }\n",
]


def _files(spark, sf, items: list[str], call: str, repeat, ending: str, head: str = "# head\n"):
    """A file for each part: up to six items, whose kinds follow its key, and an item of the first kind at the end."""
    k = F.col("p_partkey")

    def item(j):
        kind = F.when(j == F.col("p_size") % 6, 0).otherwise((k + j * 7) % len(items)).cast("int")
        text = F.replace(F.get(F.array(*map(F.lit, items)), kind), F.lit("{call}"), F.repeat(F.lit(call), repeat))
        return F.replace(text, F.lit("{j}"), j.cast("string"))

    text = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("p_size") % 6).cast("int")), item), "")
    return wide(spark, sf, "part").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(ending)).alias("path"), F.concat(F.when(k % 2 == 1, head).otherwise(""), text).alias("text"))


def _items_sql(sizes: list[str]) -> str:
    """CTEs that end in item(k, j, kind, s): every item with the line before it; sizes are lines by kind, in terms of k."""
    cases = " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(sizes))
    return f"""e AS (SELECT p_partkey AS k, p_size % 6 AS m, unnest(range(0, p_size % 6 + 1)) AS j FROM part),
i AS (SELECT k, j, CASE WHEN j = m THEN 0 ELSE (k + j * 7) % {len(sizes)} END AS kind FROM e),
n AS (SELECT *, CASE kind {cases} END AS n FROM i),
item AS (SELECT k, j, kind, (k % 2 + coalesce(sum(n) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS s FROM n)"""


@query(f"""WITH {_items_sql(["k % 3 + 2", "4", "6", "2", "3"])},
imports AS (SELECT k, CASE WHEN bool_or(kind = 3) THEN 'a.b,os' ELSE '' END AS imports FROM item GROUP BY k),
own AS (SELECT k, j, s + CASE kind WHEN 4 THEN 2 ELSE 1 END AS a, s + CASE kind WHEN 0 THEN k % 3 + 2 WHEN 1 THEN 4 WHEN 2 THEN 6 ELSE 3 END AS b, CASE kind WHEN 2 THEN 'class' ELSE 'function' END AS type, list_extract(['f', 'a', 'C', '', 'd'], kind::INT + 1) || j AS name,
  CASE kind WHEN 0 THEN 'f' || j || repeat(',g' || j, (k % 3 + 1)::INT) WHEN 1 THEN 'a' || j || ',inner,h' WHEN 2 THEN 'm,n' ELSE 'd' || j END AS symbols FROM item WHERE kind <> 3),
c AS (SELECT k, a, b, type, name, symbols FROM own UNION ALL SELECT k, 1, min(a) - 1, 'module', '', '' FROM own GROUP BY k HAVING min(a) > 1)
SELECT 'src/p' || k || '.py' AS path, a::INT AS start, b::INT AS "end", type, name, imports, symbols FROM c JOIN imports USING (k)""")
def varied_python(spark, sf):
    """Functions, nested and asynchronous ones, classes with methods, imports and decorators in changing order."""
    rows = code.chunk_code(_files(spark, sf, PYTHON, "    x = g{j}(a)\n", (F.col("p_partkey") % 3 + 1).cast("int"), ".py"))
    return rows.select("path", "start", "end", "type", "name", F.array_join("imports", ",").alias("imports"), F.array_join("symbols", ",").alias("symbols"))


@query(f"""WITH {_items_sql(["k % 4 + 2", "4", "6", "4", "9", "1"])}, c AS (
SELECT k, s + 1 AS a, s + k % 4 + 2 AS b, 'fn' AS type, 'f' || j AS name FROM item WHERE kind = 0 AND k % 4 >= 2
UNION ALL SELECT k, s + 1, s + CASE kind WHEN 2 THEN 6 ELSE 4 END, list_extract(['struct', 'impl', 'trait', 'enum'], kind::INT), list_extract(['S', 'S', 'T', 'E'], kind::INT) || j FROM item WHERE kind BETWEEN 1 AND 4
UNION ALL SELECT k, s + 2, s + 5, 'method', 'm' FROM item WHERE kind = 2 UNION ALL SELECT k, s + 5, s + 9, 'mod', 'm' || j FROM item WHERE kind = 4)
SELECT 'src/p' || k || '.rs' AS path, a::INT AS start, b::INT AS "end", type, name FROM c""")
def varied_rust(spark, sf):
    """Functions, structs, impls with methods, traits, enums and modules in changing order; those under four lines go."""
    rows = code.chunk_code(_files(spark, sf, RUST, "    a;\n", (F.col("p_partkey") % 4).cast("int"), ".rs"))
    return rows.where(F.col("type") != "code_block").select("path", "start", "end", "type", "name")


@query(f"""WITH {_items_sql(["k % 3 + 2", "4", "6", "3", "5"])}, c AS (
SELECT k, s + 1 AS a, s + k % 3 + 2 AS b, 'function' AS type, 'f' || j AS name, '' AS parent, 'f' || j AS symbols FROM item WHERE kind = 0
UNION ALL SELECT k, s + 1, s + 4, 'struct', 'S' || j, '', 'A,B' FROM item WHERE kind = 1
UNION ALL SELECT k, s + 2, s + 4, 'interface', 'I' || j, '', 'M' FROM item WHERE kind = 2 UNION ALL SELECT k, s + 5, s + 5, 'type', 'K' || j, '', '' FROM item WHERE kind = 2
UNION ALL SELECT k, s + 1, s + 3, 'method', 'm', 'S' || j, 'm' FROM item WHERE kind = 3
UNION ALL SELECT k, s + i, s + i, 'var', list_extract(['', 'x', 'y', '', 'c'], i) || j, '', '' FROM item, (VALUES (2), (3), (5)) v(i) WHERE kind = 4)
SELECT 'src/p' || k || '.go' AS path, (a + 6)::INT AS start, (b + 6)::INT AS "end", type, name, parent, symbols, 'fmt,os' AS imports FROM (SELECT * REPLACE (a - k % 2 AS a, b - k % 2 AS b) FROM c)
UNION ALL SELECT 'src/p' || p_partkey || '.go', 1, 1, 'module', 'main', '', '', 'fmt,os' FROM part""")
def varied_go(spark, sf):
    """Functions, methods, structs, grouped types and variables, constants, brackets in literals, in changing order."""
    rows = _files(spark, sf, GO, "\tg(a)\n", (F.col("p_partkey") % 3).cast("int"), ".go", "")
    rows = rows.withColumn("text", F.concat(F.lit('package main\n\nimport (\n\t"fmt"\n\t"os"\n)\n'), "text"))
    return code.chunk_code(rows).select("path", "start", "end", "type", "name", "parent", F.array_join("symbols", ",").alias("symbols"), F.array_join("imports", ",").alias("imports"))


@query(f"""WITH {_items_sql(["k % 4 + 2", "6", "1", "4"])}, c AS (
SELECT k, s + 1 AS a, s + k % 4 + 2 AS b, 'function' AS type, 'f' || j AS name, '' AS parent FROM item WHERE kind = 0 AND k % 4 >= 2
UNION ALL SELECT k, s + 1, s + 6, 'class', 'C' || j, '' FROM item WHERE kind = 1 UNION ALL SELECT k, s + 2, s + 5, 'method', 'm', 'C' || j FROM item WHERE kind = 1
UNION ALL SELECT k, s + 1, s + 4, 'function', 'h' || j, '' FROM item WHERE kind = 3)
SELECT 'src/p' || k || '.ts' AS path, a::INT AS start, b::INT AS "end", type, name, parent FROM c""")
def varied_script(spark, sf):
    """Functions, generators, classes with methods in changing order; those under four lines go."""
    rows = code.chunk_code(_files(spark, sf, SCRIPT, "  g(a);\n", (F.col("p_partkey") % 4).cast("int"), ".ts", "// head\n"))
    return rows.where(F.col("type") != "code_block").select("path", "start", "end", "type", "name", "parent")
