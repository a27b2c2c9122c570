"""Streams with timers, requests answered in time, stores with several writers, and indexes that are refreshed."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import build, segments
from weftline.sources import store
from weftline.streaming import exchange, live

LINES = "stream_id string, seq long, line string, at timestamp"


def said(text):
    return f'data: {{"choices":[{{"delta":{{"content":"{text}"}}}}]}}'


def put(spark, folder, rows, schema=LINES):
    at = schema.split(", ")[-1].split()[0]
    df = spark.createDataFrame([tuple(r) for r in rows], schema.replace("timestamp", "string"))
    df = df.withColumns({c.split()[0]: F.col(c.split()[0]).cast("timestamp") for c in schema.split(", ") if c.endswith("timestamp")})
    assert at in df.columns
    df.coalesce(1).write.mode("append").parquet(folder)


def test_fold_stream_by_event_time(spark, tmp_path):
    """A message cut by two batches, one that pauses too long, keep-alives, a retry, and lines that aren't JSON."""
    t = lambda s: f"2024-01-01 00:00:{s:02d}"
    usage = 'data: {"choices":[],"usage":{"prompt_tokens":3,"total_tokens":9,"cost":0.5}}'
    call = lambda i, **x: 'data: {"choices":[{"delta":{"tool_calls":[' + str({"index": i, **x}).replace("'", '"') + "]}}]}"
    lots = [
        [("a", 1, said("He"), t(1)), ("a", 2, "data: nonsense", t(2)), ("b", 1, said("left"), t(1)), ("c", 1, ": ping", t(1)), ("d", 1, call(1, id="x", function={"name": "ru", "arguments": "{"}), t(2))],
        [("a", 3, said("llo"), t(4)), ("a", 4, usage, t(4)), ("a", 5, "data: [DONE]", t(5)), ("a", 6, said("next"), t(6)), ("d", 2, call(1, function={"name": "n", "arguments": "}"}), t(4)), ("d", 3, ": ping", t(7)), ("d", 4, "data: [DONE]", t(10)), (None, 1, said("nobody"), t(4))],
        [("b", 2, said("retry"), t(11)), ("b", 3, "data: [DONE]", t(11))],
        [("z", 1, ": ping", "2024-01-01 01:00:00")],
    ]
    for k, lot in enumerate(lots):
        put(spark, f"{tmp_path}/in", lot)
        stream = live.fold_stream(spark.readStream.schema(LINES).parquet(f"{tmp_path}/in"))
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start()
        q.awaitTermination()
        kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        if k == 0:
            assert kept == 3  # a, b and d are open; a keep-alive alone opens nothing
    assert kept == 0
    out = {(r.stream_id, r.first): r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {k: (r.last, r.content, r.interrupted) for k, r in out.items()} == {
        ("a", 1): (5, "Hello", False), ("a", 6): (6, "next", True), ("b", 1): (1, "left", True), ("b", 2): (3, "retry", False), ("d", 1): (4, "", False), (None, 1): (1, "nobody", True),
    }
    a, d = out["a", 1], out["d", 1]
    assert (a.prompt_tokens, a.completion_tokens, a.total_tokens, a.cost, a.reasoning) == (3, 2, 9, 0.5, None)
    assert [tuple(c) for c in d.calls] == [(1, "x", "run", "{}")]


def test_fold_stream_by_the_clock(spark, tmp_path):
    """A stream that falls silent is given up by a timer, and its state goes."""
    put(spark, f"{tmp_path}/in", [("a", 1, said("half"), None), ("b", 1, said("all"), None), ("b", 2, "data: [DONE]", None)])
    stream = live.fold_stream(spark.readStream.schema(LINES).parquet(f"{tmp_path}/in"), seconds=1, clock="processing")
    q = stream.writeStream.format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/k").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("folded").count() < 2:
            time.sleep(0.5)
        while time.time() < end and not (q.lastProgress and q.lastProgress["stateOperators"] and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0):
            time.sleep(0.5)
        assert sorted((r.stream_id, r.content, r.interrupted) for r in spark.table("folded").collect()) == [("a", "half", True), ("b", "all", False)]
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        q.stop()
    with pytest.raises(ValueError, match="clock"):
        live.fold_stream(spark.readStream.schema(LINES).parquet(f"{tmp_path}/in"), clock="sand")


def test_retries(spark):
    rows = [("a", k, interrupted, total, "", []) for k, (interrupted, total) in enumerate([(True, 0), (True, 0), (True, 0), (False, 5), (True, 0), (False, 0), (True, 0)])]
    df = spark.createDataFrame(rows, "stream_id string, first int, interrupted boolean, total_tokens int, content string, calls array<string>")
    out = [(r.retry, r.again) for r in live.retries(df, most=2).orderBy("first").collect()]
    assert out == [(1, True), (2, True), (3, False), (3, False), (1, True), (1, False), (2, True)]


def test_answers_of_tables_and_streams(spark, tmp_path):
    """Late, missing, repeated, early and unasked answers, the same whether they lie in tables or come in streams."""
    asked = "id long, method string, asked_at timestamp"
    answer = "id long, result string, error string, answered_at timestamp"
    t = lambda m, s: f"2024-01-01 00:{m:02d}:{s:02d}"
    requests = [[(1, "m", t(0, 0)), (2, "m", t(0, 1)), (3, "m", t(0, 2)), (4, "m", t(0, 3)), (5, "m", t(0, 4)), (6, "m", t(0, 5))], [(7, "m", t(5, 0))], [(None, "", t(59, 0))]]
    answers = [[(1, "one", None, t(0, 9)), (1, "two", None, t(0, 8)), (2, None, "bad", t(0, 9)), (9, "who", None, t(0, 9)), (4, "edge", None, t(1, 3)), (6, "before", None, t(0, 4))], [(3, "late", None, t(1, 3)), (7, "b", None, t(5, 1)), (7, "a", None, t(5, 1))], [(None, "", None, t(59, 0))]]
    want = [(1, "result", "two", None), (2, "error", None, "bad"), (3, "timeout", None, None), (4, "result", "edge", None), (5, "timeout", None, None), (6, "timeout", None, None), (7, "result", "a", None)]
    for r, a in zip(requests, answers, strict=True):
        put(spark, f"{tmp_path}/r", r, asked)
        put(spark, f"{tmp_path}/a", a, answer)
        s = exchange.answered(spark.readStream.schema(asked).parquet(f"{tmp_path}/r"), spark.readStream.schema(answer).parquet(f"{tmp_path}/a"))
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/k").trigger(availableNow=True).start()
        q.awaitTermination()
    both = exchange.answered(spark.read.parquet(f"{tmp_path}/r"), spark.read.parquet(f"{tmp_path}/a"))
    for df in (both, spark.read.parquet(f"{tmp_path}/o")):
        assert sorted((r.id, r.state, r.result, r.error) for r in df.collect()) == want


def rows_of(spark, folder, version=None):
    return sorted(map(tuple, store.read(spark, folder, version).select("id", "v").collect()))


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, v string")


def test_store_versions(spark, tmp_path):
    folder = f"{tmp_path}/s"
    assert store.versions(spark, folder) == [] and store.notes(spark, folder) == {}
    assert store.merge(spark, folder, table(spark, [(1, "a"), (2, "b"), (3, "c")])) == 1
    before = store.read(spark, folder)
    assert store.merge(spark, folder, table(spark, [(2, "B"), (4, "d")]), gone=table(spark, [(3, ""), (9, "")])) == 2
    assert sorted(map(tuple, before.collect())) == [(1, "a"), (2, "b"), (3, "c")]  # who has begun to read goes on with the old version
    assert rows_of(spark, folder) == [(1, "a"), (2, "B"), (4, "d")] and rows_of(spark, folder, 1) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(store.Conflict):  # row 2 has changed since version 1
        store.merge(spark, folder, table(spark, [(2, "late")]), read_at=1)
    with pytest.raises(store.Conflict):  # row 3 has gone since
        store.merge(spark, folder, table(spark, [(3, "late")]), read_at=1)
    assert store.merge(spark, folder, table(spark, [(1, "A")]), read_at=1) == 3
    with pytest.raises(store.Conflict):
        store.commit(spark, folder, table(spark, []), 1)
    for bad in ([(5, "x"), (5, "y")], [(None, "x")]):
        with pytest.raises(ValueError, match="more than once"):
            store.merge(spark, folder, table(spark, bad))
    with pytest.raises(ValueError, match="no version"):
        store.read(spark, folder, 9)
    assert store.vacuum(spark, folder, keep=1) == 2 and store.versions(spark, folder) == [3]
    assert rows_of(spark, folder) == [(1, "A"), (2, "B"), (4, "d")] and len(os.listdir(f"{folder}/data")) == 1
    assert store.merge(spark, folder, table(spark, []), gone=table(spark, [(1, ""), (2, ""), (4, "")])) == 4 and rows_of(spark, folder) == []


def test_store_with_many_writers(spark, tmp_path):
    """Six writers at once lose no row, and a reader sees whole versions only."""
    folder, seen, done = f"{tmp_path}/s", set(), threading.Event()
    store.merge(spark, folder, table(spark, [(k, "old") for k in range(60)]))

    def watch():
        while not done.is_set():
            seen.add(tuple(sorted(r.v for r in store.read(spark, folder).collect() if r.id < 60)))

    reader = threading.Thread(target=watch)
    reader.start()
    writers = [threading.Thread(target=store.merge, args=(spark, folder, table(spark, [(k * 10 + i, "new") for i in range(10)] + [(100 + k, "more")]))) for k in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    done.set()
    reader.join()
    assert rows_of(spark, folder) == [(k, "new") for k in range(60)] + [(100 + k, "more") for k in range(6)]
    assert store.versions(spark, folder)[-1] == 7
    assert all(len(s) == 60 and s.count("new") % 10 == 0 for s in seen)


def write(root, files, at):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        os.utime(path, (at, at))


def test_segments_of_files(spark, tmp_path):
    """Refreshes read what changed only, and find what a full build finds; merging the segments changes nothing."""
    root, folder = tmp_path / "src", f"{tmp_path}/index"
    long = "Paragraphs hold enough words about rivers and bridges to be kept by the chunker.\n\n"
    write(root, {"a.txt": long * 3, "b.md": "# Rivers\nbridges over rivers\nand more\n", "c.py": "def bridge():\n    return 'river'\n", "d/e.txt": long + "lakes\n", "empty.txt": "x"}, 1000)
    fetched = []

    def refresh():
        current = segments.listing(spark, str(root))

        def fetch(wanted):
            fetched.append(sorted(r.path for r in wanted.collect()))
            return segments.contents(spark, str(root), wanted)

        return segments.refresh(spark, folder, current, fetch)

    def same():
        build.build_index(spark, str(root), f"{tmp_path}/full{len(fetched)}")
        for words in ("rivers", "bridge lakes", "nothing", "oceans deep", ""):
            a = [tuple(r) for r in segments.search_segments(spark, folder, words, 9).collect()]
            b = [tuple(r) for r in build.search_index(spark, f"{tmp_path}/full{len(fetched)}", words, 9).collect()]
            assert [x[:5] + x[6:] for x in a] == [x[:5] + x[6:] for x in b]
            assert [x[5] for x in a] == pytest.approx([x[5] for x in b], rel=1e-12)

    assert refresh() == {"new": 5, "changed": 0, "deleted": 0, "unchanged": 0}
    same()
    assert refresh() == {"new": 0, "changed": 0, "deleted": 0, "unchanged": 5} and len(fetched) == 1
    write(root, {"b.md": "# Oceans\ndeep oceans\nno bridges\n", "new.txt": long + "oceans\n"}, 2000)
    (root / "a.txt").unlink()
    write(root, {"c.py": "def ocean():\n    return 'river'\n"}, 1000)  # another text, the same time: not read again
    assert refresh() == {"new": 1, "changed": 1, "deleted": 1, "unchanged": 3} and fetched[-1] == ["b.md", "new.txt"]
    assert "bridge" in [r.name for r in segments.search_segments(spark, folder, "bridge", 9).collect()]
    write(root, {"c.py": "def ocean():\n    return 'river'\n"}, 3000)
    assert refresh()["changed"] == 1 and fetched[-1] == ["c.py"]
    same()
    with pytest.raises(store.Conflict):  # someone else was faster
        store.commit(spark, folder, store.read(spark, folder), 2)
    segments.compact(spark, folder)
    assert len(store.notes(spark, folder)["segments"]) == 1
    same()
    (root / "b.md").unlink()
    assert refresh()["deleted"] == 1
    same()
