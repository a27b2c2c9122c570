"""Steps that must not change with the size of their input: what is broadcast, what one task or one row holds."""

from __future__ import annotations

from pyspark.sql import functions as F

import json
import random

import pyarrow as pa
from conftest import SF, same_rows
from weftline.functions import inline
from weftline.functions import text as T
from weftline.operators import search, segments, tasks
from weftline.plans.registry import oracle_sql, queries
from weftline.sources import files, store
from weftline.sources.places import dealt


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_of_tasks_are_not_broadcast(spark):
    t = spark.range(100).select("id", F.lit("a").alias("agent"), F.lit("pending").alias("status"), F.lit("p").alias("prompt"))
    edits = t.select("id", "agent", "status", F.lit("q").alias("prompt"), F.lit(None).cast("string").alias("reviewer_agent"))
    good = tasks.checked_edits(edits, t, t.select(F.col("agent").alias("name")))
    assert "SortMergeJoin [id" in plan(good)
    new = tasks.edited(t, good)
    assert "BroadcastHashJoin [id" not in plan(new)
    assert {r.prompt for r in new.collect()} == {"q"}


def test_a_merge_of_many_keys_deals_them_out(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(store, "FEW_KEYS", 10)
    commit = store.commit
    monkeypatch.setattr(store, "commit", lambda s, folder, rows, base, notes=None: (seen.append(plan(rows)), commit(s, folder, rows, base, notes))[1])
    rows = spark.range(100).withColumn("v", F.lit(0))
    store.merge(spark, str(tmp_path), rows)
    store.merge(spark, str(tmp_path), rows.where("id < 50").withColumn("v", F.lit(1)), gone=rows.where("id >= 90"))
    store.merge(spark, str(tmp_path), rows.where("id < 5").withColumn("v", F.lit(2)), read_at=2)
    assert "Broadcast" not in seen[1] and "BroadcastHashJoin" in seen[2]
    got = {r.id: r.v for r in store.read(spark, str(tmp_path)).collect()}
    assert got == {i: 2 if i < 5 else int(i < 50) for i in range(90)}


def test_contexts_of_a_million(spark):
    row = spark.range(1).select(T.format_context(F.lit(1_234_567)).alias("m"), T.format_context(F.lit(1_234_567), millions=False).alias("k")).first()
    assert tuple(row) == ("1M", "1234K")


def test_price_format_beyond_a_million_parts(spark, duck, tmp_path):
    spark.range(999_998, 1_000_003).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    parts = f"(SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet'))"
    same_rows(queries()["price_format"](spark, str(tmp_path)), duck.sql(oracle_sql()["price_format"].replace("FROM part", f"FROM {parts}")))


def test_pages_of_one_address_stay_apart(spark, duck, tmp_path):
    html = F.concat(F.lit("<p>"), F.repeat(F.concat(F.lit("page "), F.col("id").cast("string"), F.lit(" ")), 20), F.lit("</p>"))
    spark.range(9).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.example/"), (F.col("id") % 4).cast("string")).alias("url"), html.alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    pages = f"(SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet'))"
    found = queries()["web_results"](spark, str(tmp_path))
    assert found.count() == 45
    same_rows(found, duck.sql(f"WITH pages AS {pages}, {oracle_sql()['web_results'].removeprefix('WITH ')}"))


def test_results_stay_single_where_pages_are_known_twice(spark):
    found = spark.createDataFrame([(1, 0, "u"), (1, 1, "v"), (2, 0, "u")], "s long, pos int, url string")
    pages = spark.createDataFrame([("u", "<p>" + "b" * 120 + "</p>"), ("u", "<p>" + "a" * 120 + "</p>")], "url string, html string")
    got = [(r.s, r.pos, r.page and r.page[0]) for r in T.with_pages(found, pages, "s", "pos").orderBy("s", "pos").collect()]
    assert got == [(1, 0, "a"), (1, 1, None), (2, 0, "a")]


def test_tables_are_dealt_out_by_their_bytes(spark, tmp_path):
    spark.range(1000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(f"{tmp_path}/a b")
    rows = spark.read.parquet(f"{tmp_path}/a b")
    assert dealt(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    few = dealt(rows, 2000)
    assert few.rdd.getNumPartitions() > 20 and few.exceptAll(rows).count() == 0 and few.count() == 1000


def test_words_are_cut_where_they_were(spark):
    before = r"[^\p{L}\p{Nd}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    pick = random.Random(5)
    texts = ["".join(pick.choice("aaBBbC1٣ǅʰ中é漢ß ́-_Σσ𝐀𝐚𝟙İ") for _ in range(pick.randint(0, 14))) for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    assert not rows.where(F.split("t", T.BREAK) != F.split("t", before)).count()


def test_large_task_tables_are_written_in_parts(spark, tmp_path):
    folder, t = str(tmp_path / "t"), spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("agent"))
    read = lambda: sorted(int(r.id) for r in files.read_tasks(spark, folder).collect())
    parts = lambda: sorted((tmp_path / "t" / ".parts").iterdir())
    for n in (1000, 900, 800):
        files.write_tasks(t.where(F.col("id").cast("int") < n), folder, most=50)
        assert read() == list(range(n))
    assert len(parts()) == 2  # the last and the one it replaced
    assert all(len(json.loads(f.read_text())["tasks"]) <= 50 for p in parts() for f in p.glob("*.json"))
    files.write_tasks(t.where(F.col("id").cast("int") < 10), folder, most=50)
    assert read() == list(range(10)) and len(parts()) == 1
    assert json.loads((tmp_path / "t" / "tasks.json").read_text())["tasks"][0] == {"id": "0", "agent": None}
    files.write_tasks(t.limit(0), folder, most=50)
    assert read() == []


def test_files_of_code_go_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert all(queries()[name](spark, SF).rdd.getNumPartitions() >= cores for name in ("varied_python", "varied_go"))


def test_spans_are_columns_of_numbers():
    spans = inline._spans(pa.array(["a **b**", None, ""]))
    assert isinstance(spans, pa.ListArray) and spans.to_pylist() == [[{"start": 4, "end": 5, "kind": "bold"}], None, []]


def test_terms_are_counted_as_they_are_cut(spark):
    pick = random.Random(7)
    texts = ["".join(pick.choice("aaesñéBBÑ1٣ǅʰ中漢ß ́-_ΣσİŁ½\n\U0001df00") for _ in range(pick.randint(0, 30))) for _ in range(3000)] + [None, "", "los las"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = rows.unionByName(spark.sql("SELECT -1L AS doc_id, cast(X'6162E163FF646566' AS string) AS text"))
    counts = search.counted(rows)
    assert "Exchange" not in plan(search.counted(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))))
    got = {r.doc_id: (r.num_tokens, dict(zip(r.terms.split(" ") if r.terms else [], r.tfs))) for r in counts.collect()}
    want = {r.doc_id: r.t or [] for r in rows.select("doc_id", T.tokenize(F.col("text")).alias("t")).collect()}
    assert got == {k: (len(v), {x: v.count(x) for x in v}) for k, v in want.items()}
    # Beyond 16 bits Spark's expressions may cut within a letter; here they are whole, as in a query and in the SQL.
    assert T.count_terms(pa.array(["ñ𝐀 a𝟙 𝐚𝐀𝐚 x"]))[1].to_pylist() == [T.tokenize_query("ñ𝐀 a𝟙 𝐚𝐀𝐚 x")] == [["𝐀", "𝟙", "𝐚", "𝐀𝐚"]]


def test_a_saved_index_has_blocks_and_keeps_all_documents(spark, tmp_path):
    """A term has a row a part and not a row a document; ids that stand several times or are missing count as in postings()."""
    said = [(1, "alpha beta"), (2, "beta"), (2, "beta gamma"), (None, "beta"), (None, "delta"), (3, ""), (4, None)] + [(i, "beta omega") for i in range(10, 60)]
    docs = spark.createDataFrame(said, "doc_id long, text string").coalesce(1)
    for rows, name in ((docs, "a"), (docs.where("doc_id > 2"), "b"), (docs.limit(0), "c")):
        path = f"{tmp_path}/{name}"
        search.save(rows, path)
        posted, sizes, _ = search.load(spark, path)
        old = search.postings(rows)
        order = lambda df: sorted(map(str, df.collect()))
        assert order(posted) == order(old.select("term", "doc_id", "tf")) and order(sizes) == order(search.lengths(rows, old))
    assert spark.read.parquet(f"{tmp_path}/b/postings").groupBy("term").count().where("count > 1").isEmpty()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,beta)]" in plan(search.load(spark, f"{tmp_path}/b")[0].where("term = 'beta'"))


def test_what_a_refresh_takes_out_is_counted_by_chunks(spark, tmp_path, monkeypatch):
    """No refresh and no merge reads or joins the old segments' postings; the merged index has the counts of a full one."""
    read, seen = segments._tables, []
    monkeypatch.setattr(segments, "_tables", lambda s, folder, name, parts: (seen.append(name), read(s, folder, name, parts))[1])
    whole = lambda f: f.select("path", F.lit(1).alias("start"), F.lit(1).alias("end"), F.lit("t").alias("type"), F.lit("").alias("name"), "text")
    folder = f"{tmp_path}/i"
    for at in (1, 2):
        files = spark.range(30).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") % 3 == 0, at).otherwise(1).cast("long").alias("mtime"), F.concat(F.lit("common w"), "id", F.lit("x"), F.when(F.col("id") % 3 == 0, f" round{at}").otherwise("")).alias("text")).where(f"id < 30 - {at}")
        segments.refresh(spark, folder, files.select("path", "mtime"), lambda w, f=files: f.join(w, "path", "left_semi"), whole)
    df = lambda: {r.term: r.df for r in read(spark, folder, "terms", segments.store.notes(spark, folder)["segments"]).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").collect()}
    want = {r.term: r.df for r in search.postings(files, "path").groupBy("term").agg(F.count("*").alias("df")).collect()}
    before = df()
    name = segments.compact(spark, folder)
    assert before == df() == want and "postings" not in seen
    posted = search.flat(read(spark, folder, "postings", [name]), "id")
    assert {r.term: r.n for r in posted.groupBy("term").agg(F.count("*").alias("n")).collect()} == want
