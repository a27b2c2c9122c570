"""Registered queries that take whole tables and texts."""

from conftest import SF
from pyspark.sql import functions as F

from weftline.operators import search
from weftline.plans import registry


def test_facts_of_all_customers(spark):
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    q = registry.queries()
    assert n > 40 and q["fact_upsert"](spark, SF).count() == n + 1 and q["fact_delete"](spark, SF).count() == n - 2
    assert q["fact_search"](spark, SF).where("line_no > 0 and store <> '0'").count() > 0


def test_image_uri_of_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = registry.queries()["image_uri"](spark, SF).withColumn("back", F.unbase64(F.substring_index("uri", ",", -1)).cast("string"))
    assert got.where(F.col("uri").contains("\n")).count() == 0
    assert docs.where("length(text) > 30").count() and got.join(docs, "doc_id").where("back <> text").count() == 0


def test_counts_of_a_long_document(spark):
    docs = spark.sql("SELECT 1 AS doc_id, repeat('zebra ', 70000) AS text")
    posted = search.postings(docs)
    sizes = search.lengths(docs, posted)
    assert posted.first()["tf"] == 70_000 and sizes.first()["num_tokens"] == 70_000
    stats = search.corpus_stats(sizes).first()
    assert stats["total"] == 70_000 and stats["avgdl"] == 70_000


def test_query_and_index_tokens_agree(spark):
    """The driver's tokenizer and the columns': accents, other scripts, cases, fractions, short stems."""
    from weftline.functions import text as T
    from weftline.operators import search

    said = ["książka leży na półce", "½ tasse", "getUserData v2api HTTPServer2", "øas øs ñas", "Größe über ÄÖÜ", "слова Словарь", "漢字テスト 東京2020", "naïve CAFÉ", "x_y-z", "٣٤abc", "", "İstanbul ǅungla", "a bb ccc", "los las corriendo rápidamente"]
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r["doc_id"]: r["t"] for r in rows.select("doc_id", T.tokenize(F.col("text")).alias("t")).collect()}
    assert [got[i] for i in range(len(said))] == [T.tokenize_query(x) for x in said]
    each = {r["doc_id"]: sorted(r["t"]) for r in T.token_rows(rows, F.col("text"), "doc_id").groupBy("doc_id").agg(F.collect_list("term").alias("t")).collect()}
    assert all(each.get(i, []) == sorted(got[i]) for i in range(len(said)))
    for word in ("książka", "leży", "Größe", "Словарь"):
        assert [r["doc_id"] for r in search.search(rows, word, expand=False).collect()] == [i for i, x in enumerate(said) if set(T.tokenize_query(word)) & set(got[i])]
    stored = search.postings(rows)
    sizes = search.lengths(rows, stored)
    a = search.scores(stored, sizes, search.corpus_stats(sizes), ["książk", "dat"]).orderBy("doc_id").collect()
    b = search.query_scores(rows, ["książk", "dat"]).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in a] == [r["doc_id"] for r in b] and all(abs(x["score"] - y["score"]) < 1e-12 for x, y in zip(a, b, strict=True))


def test_entities_as_html_decodes_them(spark):
    import html

    from weftline.functions import text as T

    said = ["&amp;lt; &lt;b&gt; &copy &copy; &notit; &notin; &hellip;x &CounterClockwiseContourIntegral; &#39;&#x27;&#X41;", "&#128; &#0; &#13; &#55296; &#1114112; &#1; &#65534;", "&; &# &#x; &nosuch; &nosuch a&b &ampx &AMP &frac12; &frac12", "none", "", "&eacute;&Eacute &NotEqualTilde; &#99999999999;"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, s string")
    got = [r["x"] for r in rows.select("i", T.unescape(F.col("s")).alias("x")).orderBy("i").collect()]
    want = [html.unescape(x) for x in said]
    assert got[:3] == want[:3] and got[3:5] == want[3:5] and got[5].startswith(want[5][:5])


def test_front_matter_cases(spark):
    from weftline.functions import text as T

    row = spark.sql("SELECT '---\\na: 1\\na: 2\\n# c: 3\\nq: \\'x: y\\'\\nyes: No\\n...\\nbody' AS s").select(T.front_matter(F.col("s")).alias("f")).first()["f"]
    assert row["fields"] == {"a": "2", "q": "x: y", "yes": "false"} and row["body"] == "body"


def test_canonical_arguments(spark):
    from weftline.operators import trail

    said = ['{"b": 1, "a": {"y": [1, 2], "x": "s"}}', '{"a":{"x":"s","y":[1,2]},"b":1}', '{"a":1}', '{"a":"1"}', "[1, 2]", "[1,2]", "not json", '{"a":1,"a":2}', None]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(said)), "i int, s string").select("i", trail.canonical_args(F.col("s")).alias("x")).orderBy("i").collect()]
    assert got[0] == got[1] and got[2] != got[3] and got[4] == got[5] and got[6] == "not json" and got[7] == '{"a":1,"a":2}' and got[8] is None


def test_poll_takes_due_tasks(spark, tmp_path):
    import time

    from weftline.streaming.poll import poll

    tasks = spark.createDataFrame([(i, "pending" if i < 2 else "done", i) for i in range(4)], "id int, status string, pos int").withColumn("next_run", F.current_timestamp() - F.expr("INTERVAL 1 MINUTE"))
    seen = []
    loop = poll(spark, lambda: tasks, lambda due, n: seen.append([r["id"] for r in due.collect()]), str(tmp_path / "c"), seconds=1)
    try:
        for _ in range(60):
            if seen:
                break
            time.sleep(0.5)
    finally:
        loop.stop()
    assert seen and seen[0] == [0, 1]


def test_index_from_files_end_to_end(spark, tmp_path):
    from weftline.operators import build

    root = tmp_path / "src"
    for name, body in {"a.py": b"import os\n\ndef getUserData(x):\n    return os.getcwd()\n", "b.md": b"# Title\nabout zebras\nmore\n", "c.txt": b"one long paragraph of text about zebras and more than fifty bytes", "d.go": b"package d\n\nfunc Zebra() int {\n\treturn 1\n}\n", "bad.txt": b"zebra \xff " + b"x" * 60, ".git/x.py": b"def hidden():\n    pass\n", "node_modules/y.md": b"# no\nx\ny\n", "z.cfg": b"key = zebra\n"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    chunks = build.build_index(spark, str(root), str(tmp_path / "index"))
    assert {r["path"] for r in chunks.select("path").collect()} == {"a.py", "b.md", "c.txt", "d.go", "bad.txt", "z.cfg"}
    found = build.search_index(spark, str(tmp_path / "index"), "zebra", 10).collect()
    assert found[0]["path"] == "d.go" and {r["path"] for r in found} == {"b.md", "c.txt", "d.go", "bad.txt", "z.cfg"}  # the name weighs
    assert build.search_index(spark, str(tmp_path / "index"), "get user data").collect()[0]["name"] == "getUserData"
    assert search.to_json(build.search_index(spark, str(tmp_path / "index"), "nosuchword")).first()["json"] == "[]"


def test_match_grammar(spark):
    import pytest

    from weftline.operators import match

    said = {1: "The quick brown fox", 2: "quick fox, brown dog", 3: "Árbol and foxes", 4: None, 5: "dog dog dog", 6: ""}
    rows = spark.createDataFrame(list(said.items()), "id int, text string")
    for query, want in {"quick brown": {1, 2}, '"quick brown"': {1}, "fox*": {1, 2, 3}, "quick NOT dog": {1}, "dog OR arbol": {2, 3, 5}, "(dog OR fox) AND brown": {1, 2}, '"quick bro" *': {1}, "quick AND NOTHING": set(), "dog NOT quick OR arbol": {3, 5}, "ÁRBOL": {3}}.items():
        assert {r["id"] for r in match.match(rows, query).collect()} == want, query
    assert [r["id"] for r in match.match(rows, "dog").collect()] == [5, 2]
    for bad in ("", "AND x", "(x", "x )", '"', "NOT x", "x OR"):
        with pytest.raises(ValueError):
            match.parse(bad)
