"""Hand-computed cases for what SQL doesn't reach, and properties."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import chunking, code, edits, history, search, tasks, trail
from weftline.sources import files
from weftline.streaming import deltas, index, limits


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("configuración archivos buscando usuarios", ["configuracion", "arch", "busc", "usu"]),
        ("getUserData HTTPServer v2api", ["get", "us", "dat", "http", "serv", "api"]),
        ("año a the ß", ["ano", "ß"]),
        ("", []),
    ],
)
def test_tokenize(spark, text, tokens):
    assert one(spark, T.tokenize(F.col("t")), t=text) == tokens
    assert T.tokenize_query(text) == tokens


def test_synonyms_follow_their_token():
    assert T.expand_query(["error", "find", "error"])[:2] == ["error", "err"]
    assert T.expand_query([]) == []


def test_section_header(spark):
    cases = {"## Title": "Title", "Chapter 3 of it": "Chapter 3 of it", "ALL CAPITALS HERE": "ALL CAPITALS HERE", "SHORT": None, "**Bold one**": "Bold one*", "*Slanted*": "Slanted", "**ab**": None, "plain": None}
    for line, title in cases.items():
        assert one(spark, T.section_header(F.col("t")), t=line) == title, line


def test_linear_windows_cover_every_line(spark):
    for n in (1, 29, 30, 31, 45, 200):
        df = spark.createDataFrame([(1, "\n".join(map(str, range(1, n + 1))))], "doc_id int, text string")
        rows = chunking.linear(df).orderBy("start").collect()
        assert {i for r in rows for i in range(r["start"], r["end"] + 1)} == set(range(1, n + 1))
        assert all(b["start"] - a["start"] == 14 for a, b in zip(rows, rows[1:], strict=False))
        assert [r["chunk"].split("\n")[0] for r in rows] == [str(r["start"]) for r in rows]
    with pytest.raises(ValueError, match="overlap"):
        chunking.linear(df, 10, 9)


def test_sections(spark):
    text = "# One\na\nb\n---\nc\n**Two two**\nd"
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    plain = [(r["start"], r["end"], r["name"], r["chunk"]) for r in chunking.sections(df, 0).orderBy("start").collect()]
    assert plain == [(1, 3, "One", "# One\na"), (4, 5, "", "---"), (6, 7, "Two two*", "**Two two**\nd")]
    full = [r["chunk"] for r in chunking.sections(df, 50).orderBy("start").collect()]
    assert full == ["# One\na\nb", "# One\na\nb\n---\nc", "---\nc\n**Two two**\nd"]


def test_paragraphs_merge_and_skip(spark):
    small, big = "tiny", "line\n" * 3 + "x" * 80
    df = spark.createDataFrame([(1, f"{small}\n\n{big}\n\n{small}\n\n" + "\n".join(["y"] * 250))], "doc_id int, text string")
    rows = [(r["start"], r["end"]) for r in chunking.paragraphs(df, 100).orderBy("start").collect()]
    assert rows == [(3, 8), (10, 259)]


def test_chapters(spark):
    body = "\n".join("abcdef")
    df = spark.createDataFrame([(1, f"before\nChapter 1\n{body}\nChapter 2\nshort\nChapter 3\n{body}")], "doc_id int, text string")
    assert [(r["start"], r["end"], r["name"]) for r in chunking.chapters(df).orderBy("start").collect()] == [(2, 8, "Chapter 1"), (11, 17, "Chapter 3")]


def test_snippet(spark):
    text = "x\n\n# h\na\nreou hent\nb\n\ny"
    assert one(spark, search.snippet(F.col("t"), ["reou", "hent"]), t=text) == "a\nreou hent\nb"
    assert one(spark, search.snippet(F.col("t"), ["none"]), t="1\n2\n3\n4\n5\n6\n7") == "1\n2\n3\n4\n5\n6"


def test_field_weight(spark):
    names = F.array(F.lit("getUser"), F.lit("x"))
    w = search.field_weight(["user", "user", "class"], F.lit("UserStore"), F.lit("class"), names, names, F.lit(None).cast("string"))
    assert one(spark, w, t=1) == pytest.approx(1 + 2 * (1.5 + 1.0 + 0.5) + 0.3)


def test_saved_index_answers_like_a_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, ""), (4, None)], "doc_id int, text string")
    search.save(docs, str(tmp_path / "i"))
    posted, sizes, stats = search.load(spark, str(tmp_path / "i"))
    got = search.top_k(search.scores(posted, sizes, stats, T.tokenize_query("beta alpha")), 5).collect()
    assert got == search.search(docs, "beta alpha", 5, expand=False).collect()
    assert [r["doc_id"] for r in got] == [1, 2] and sizes.count() == 4


def test_repeat_alerts(spark):
    trails = {1: "AAA", 2: "BAAA", 3: "AAAB", 4: "AA", 5: "AAA"}
    rows = [(r, i, c, json.dumps({"a": 1, "b": 2}) if (r, i) != (5, 1) else '{"b": 2, "a": 1}') for r, t in trails.items() for i, c in enumerate(t)]
    df = spark.createDataFrame(rows, "round int, seq int, name string, args string")
    assert sorted(r["round"] for r in trail.repeat_alerts(df).collect()) == [1, 2, 5]


def test_admission():
    got, recent = limits.admitted([0, 10, 20, 30, 53, 54, 60], [])
    assert got[:3] == [0, 10, 20] and got[3] == 60 and got == sorted(got)
    first, state = limits.admitted([0, 10, 20], [])
    assert first + limits.admitted([30, 53, 54, 60], state)[0] == got


def test_stream_admission_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 10, 20, 30, 53])], "user_id long, event_id long, at double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = limits.admit(stream).writeStream.format("memory").queryName("admitted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [r["admitted"] for r in spark.sql("SELECT * FROM admitted ORDER BY event_id").collect()]
    assert got == limits.admitted([0, 10, 20, 30, 53], [])[0]


def test_stream_index_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "s", "alpha beta"), (2, "s", "beta"), (3, None, "lost"), (4, "s", "")], "id long, session_id string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    index.follow(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "ix/postings")).select("term", "id", "tf").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, search.postings(index.storable(rows), "id").collect()))


def test_fold_deltas(spark):
    lines = ['data: {"choices":[{"delta":{"content":"He"}}]}', "", "data: bad", 'data: {"choices":[{"delta":{"content":"y","tool_calls":[{"index":1,"id":"c1","function":{"name":"ru","arguments":"{\\"a\\""}}]}}]}']
    lines += ['data: {"choices":[{"delta":{"tool_calls":[{"index":0,"id":"c0","function":{"name":"x","arguments":""}},{"index":1,"function":{"name":"n","arguments":":1}"}}]}}]}', 'data: {"usage":{"total_tokens":0},"choices":[]}', 'data: {"usage":{"total_tokens":9},"choices":[]}', "data: [DONE]"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "stream_id int, seq int, line string")
    parsed = deltas.parse_deltas(df)
    m = deltas.fold_messages(parsed).first()
    assert (m["content"], m["completion_tokens"], m["total_tokens"], m["reasoning"]) == ("Hey", 2, 9, None)
    assert [(c["index"], c["id"], c["name"], c["arguments"]) for c in deltas.fold_calls(parsed).orderBy("index").collect()] == [(0, "c0", "x", ""), (1, "c1", "run", '{"a":1}')]


def test_transition_never_passes_max_retries(spark):
    rows = [(s, t, ok, rev, r, 3, i) for s in ("pending", "review") for t in ("idle", "onehot") for ok in (True, False) for rev in (None, "a") for r in range(4) for i in (30, 40000)]
    df = spark.createDataFrame(rows, "status string, type string, ok boolean, reviewer_agent string, retries int, max_retries int, interval_secs int")
    out = tasks.transition(df, F.timestamp_seconds(F.lit(0))).collect()
    assert all(r["new_status"] in tasks.STATUSES and (r["new_status"] != "pending" or r["new_retries"] < 3) for r in out)
    assert {r["delay"] for r in out if r["type"] == "idle" and not r["ok"] and r["retries"] >= 2 and r["status"] == "pending"} == {120, 86400}


def test_python_pieces():
    src = "import os\nfrom a import b\n\n@deco\ndef f(x):\n    return g(x)\n\nclass C:\n    async def m(self):\n        pass\n"
    got = [(p.start, p.end, p.type, p.name, p.symbols, p.imports) for p in code.python_pieces(src)]
    assert got == [(1, 4, "module", "", [], ["a", "os"]), (5, 6, "function", "f", ["f", "g"], ["a", "os"]), (8, 10, "class", "C", ["m"], ["a", "os"])]
    assert code.python_pieces("def (") == [] and code.python_pieces("x = 1") == []


def test_brace_pieces():
    js = "class A {\n  x() {}\n  function run() {\n    a\n    b\n  }\n}\nfunction f() { return 1 }\n"
    got = [(p.start, p.end, p.type, p.name, p.parent) for p in code.brace_pieces(js)]
    assert got == [(3, 6, "method", "run", "A"), (1, 7, "class", "A", "")]
    assert code.brace_pieces(js)[0].text == "class A {\n  function run() {\n    a\n    b"
    rust = "impl Foo {\n    fn bar() {\n        1;\n        2\n    }\n}\n"
    assert [(p.type, p.name) for p in code.rust_pieces(rust)] == [("method", "bar"), ("impl", "Foo")]


def test_go_pieces():
    go = 'package main\n\nimport "fmt"\n\ntype T struct {\n\tA int\n\tB string // }\n}\n\nfunc (t *T) M() {\n\tfmt.Println("{")\n}\n\nvar x = 1\n\nfunc main() {\n}\n'
    got = [(p.type, p.name, p.parent, p.start, p.end) for p in code.go_pieces(go)]
    assert got == [("module", "main", "", 1, 1), ("struct", "T", "", 5, 8), ("method", "M", "T", 10, 12), ("var", "x", "", 14, 14), ("function", "main", "", 16, 17)]
    assert code.go_pieces(go)[1].symbols == ["A", "B"] and code.go_pieces(go)[2].text.startswith("type T struct")


def test_chunk_code(spark):
    df = spark.createDataFrame([("a.py", "def f():\n    pass\n"), ("b.txt", "x\ny"), ("c.js", "x"), ("d.py", "def ("), (None, "x"), ("e.rs", None)], "path string, text string")
    assert sorted((r["path"], r["type"]) for r in code.chunk_code(df).collect()) == [("a.py", "function"), ("b.txt", "code_block"), ("c.js", "code_block")]


def test_apply_patch(spark):
    patch = "--- a\n+++ f.txt\n@@ -1 +1 @@\n one\n-two\n+TWO\n@@ @@\n-missing\n+x\n+++ g.txt\n@@ @@\n+added"
    df = spark.createDataFrame([("f.txt", "zero\none\ntwo\nthree"), ("g.txt", "g"), ("h.txt", "h")], "path string, text string")
    got = {r["path"]: (r["patched"], r["applied"], r["failed"]) for r in code.apply_patch(df, patch).collect()}
    assert got == {"f.txt": ("zero\none\nTWO\nthree", 1, 1), "g.txt": ("g\nadded\n", 1, 0), "h.txt": ("h", 0, 0)}


def test_display_width(spark):
    assert [code.width(x) for x in ("abc", "漢字", "é", "❤️", "a\u200bb")] == [3, 4, 1, 2, 2]
    df = spark.createDataFrame([("t", "| a | 漢字 |"), ("t", "| abc | x |")], "t string, line string")
    assert [(r["at"], r["width"]) for r in code.column_widths(df, T.table_cells(F.col("line")), "t").orderBy("at").collect()] == [(0, 3), (1, 4)]


def test_files(spark, tmp_path):
    for name in ("a.txt", "src/b.py", "node_modules/c.js", ".hid/d.txt", "big.bin", "empty"):
        p = tmp_path / "r" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * (600_000 if name == "big.bin" else 0 if name == "empty" else 3))
    assert sorted(r["path"] for r in files.scan(spark, str(tmp_path / "r")).collect()) == ["a.txt", "src/b.py"]
    (tmp_path / "t.json").write_text(json.dumps({"tasks": [{"id": "1", "status": "pending", "tags": ["x"]}]}))
    (tmp_path / "bad.json").write_text("{nope")
    assert [(r["id"], r["tags"]) for r in files.read_tasks(spark, str(tmp_path / "t.json")).collect()] == [("1", ["x"])]
    assert files.read_tasks(spark, str(tmp_path / "bad.json")).count() == 0


def test_globs_and_history(spark):
    import re

    for pattern, path, hit in [("*.py", "a.py", True), ("*.py", "x/a.py", False), ("**/*.py", "x/y/a.py", True), ("**/*.py", "a.py", True), ("a?c", "abc", True), ("a+b", "a+b", True)]:
        assert bool(re.match(edits.glob_pattern(pattern), path)) == hit
    assert one(spark, history.head_and_tail(F.col("t")), t="x" * 4000) == "x" * 1485 + " ... (contenido truncado) ..." + "x" * 1486
