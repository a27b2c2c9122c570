"""Project files under ignore rules, and a catalog with a cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.plans.registry import query, read, scratch
from weftline.sources import cached, ignore, store

#: Ignore files by their path; the SQL below states what they mean case by case.
IGNORES = {
    ".gitignore": "# logs, and what is built\n*.log  \nbuild/\n/en/src/cache\n**/keep/**/*.tmp\n\nde/**\n!de/keep/\npages/*/1*\n!pages/*/1[!0-4]*\n\\#hash\nd?/none\n",
    "fr/.gitignore": "!*.log\n/src/[0-4]*.md\n",
    "es/keep/.gitignore": "*\n!*.txt\n",
}

_PATHS = """SELECT l || '/' || m || '/' || CASE WHEN c THEN 'cache/' ELSE '' END || i || '.' || e AS path, * FROM (SELECT lang AS l, list_extract(['build', 'keep', 'src'], (doc_id // 8 % 3 + 1)::INT) AS m, doc_id % 2 = 1 AS c, doc_id AS i,
list_extract(['txt', 'log', 'tmp', 'md'], (doc_id // 2 % 4 + 1)::INT) AS e FROM documents)"""

IGNORED = f"""WITH f AS ({_PATHS}), p AS (SELECT 'pages' || regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages),
d AS (SELECT path, l = 'de' OR m = 'build' OR (l = 'en' AND m = 'src' AND c) OR (e = 'tmp' AND m = 'keep') OR (e = 'log' AND l <> 'fr')
  OR (l = 'fr' AND m = 'src' AND NOT c AND e = 'md' AND regexp_matches(i::VARCHAR, '^[0-4]')) OR (l = 'es' AND m = 'keep' AND (c OR e <> 'txt')) AS gone FROM f
  UNION ALL SELECT path, regexp_matches(path, '^pages/[^/]+/1') AND NOT regexp_matches(path, '^pages/[^/]+/1[^0-4]') FROM p)
SELECT DISTINCT path FROM d WHERE NOT gone"""


@query(IGNORED)
def project_scan(spark, sf):
    """Documents and pages as files of a project with ignore files at three depths."""
    k = F.col("doc_id")
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    path = F.concat("lang", F.lit("/"), pick(["build", "keep", "src"], F.floor(k / 8) % 3), F.lit("/"), F.when(k % 2 == 1, "cache/").otherwise(""), k.cast("string"), F.lit("."), pick(["txt", "log", "tmp", "md"], F.floor(k / 2) % 4))
    docs = read(spark, sf, "documents").select(path.alias("path"), F.lit(None).cast("string").alias("text"))
    pages = read(spark, sf, "pages").select(F.concat(F.lit("pages"), F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)).alias("path"), F.lit(None).cast("string").alias("text"))
    own = spark.createDataFrame(list(IGNORES.items()), "path string, text string")
    files = docs.unionAll(pages).distinct().unionAll(own).withColumn("length", F.lit(1))
    return ignore.project_scan(files).where(~F.col("path").endswith(".gitignore")).select("path")


_CATALOG = "SELECT p_partkey AS id, p_name AS name, round(p_retailprice * {factor}, 2) AS price FROM part WHERE {where}"


@query(f"""SELECT 'first' AS read, 'fetched' AS state, * FROM ({_CATALOG.format(factor="1", where="true")}) UNION ALL SELECT 'soon', 'fresh', * FROM ({_CATALOG.format(factor="1", where="true")})
UNION ALL SELECT 'late', 'fetched', * FROM ({_CATALOG.format(factor="2", where="p_partkey % 3 <> 0")}) UNION ALL SELECT 'failing', 'stale', * FROM ({_CATALOG.format(factor="2", where="p_partkey % 3 <> 0")})""")
def cached_catalog(spark, sf):
    """A catalog read four times: first, inside the hour while prices have changed, after it, and when fetching fails half-way."""
    folder, p = scratch(spark), read(spark, sf, "part")
    rows = lambda factor, where: p.where(where).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.round(F.col("p_retailprice") * factor, 2).alias("price"))
    broken = rows(3, "true").withColumn("name", F.when(F.col("id") % 10 == 5, F.raise_error(F.lit("connection lost"))).otherwise(F.col("name")))
    out = None
    for name, at, fetched in (("first", 0, rows(1, "true")), ("soon", 3599, rows(9, "true")), ("late", 3600, rows(2, "p_partkey % 3 <> 0")), ("failing", 9999, broken)):
        got, state = cached.cached(spark, folder, lambda f=fetched: f, at)
        got = got.select(F.lit(name).alias("read"), F.lit(state).alias("state"), "id", "name", "price")
        out = got if out is None else out.unionAll(got)
    assert store.versions(spark, folder) == [1, 2]
    return out
