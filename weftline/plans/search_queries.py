"""Tokens, index, ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import catalog, search
from weftline.plans.registry import query, read, scratch, wide
from weftline.plans.sqltext import bm25, tokens

QUERY = "the reinheon thanoned atoust"
# What the queries are as tokens, written out so that the SQL does not rest on the tokenizer under test.
BASE = ["reinheon", "thanoned", "atoust"]
EXPANDED = "find error thanon"
FULL = ["find", "busc", "encontr", "localiz", "error", "err", "fall", "exception", "thanon"]


@query(f"WITH {tokens()} SELECT d.doc_id, count(term)::BIGINT AS n_tokens, coalesce(md5(string_agg(term, ' ' ORDER BY pos)), md5('')) AS digest FROM documents d LEFT JOIN token USING (doc_id) GROUP BY d.doc_id")
def tokenize(spark, sf):
    t = T.tokenize(F.col("text"))
    return wide(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"WITH {tokens()} SELECT doc_id, term, count(*)::BIGINT AS tf FROM token GROUP BY ALL")
def term_freq(spark, sf):
    return search.postings(wide(spark, sf, "documents")).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@query(f"WITH {tokens()}, dfs AS (SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM token GROUP BY term) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, (SELECT count(*) AS n FROM documents)")
def doc_freq_idf(spark, sf):
    docs = wide(spark, sf, "documents")
    posted = search.postings(docs)
    return search.term_stats(posted, docs.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {tokens()}, size AS (SELECT d.doc_id, count(term) AS c FROM documents d LEFT JOIN token USING (doc_id) GROUP BY d.doc_id) SELECT count(*)::BIGINT AS n, sum(c)::BIGINT AS total, round(avg(c), 6) AS avgdl FROM size")
def corpus_stats(spark, sf):
    docs = wide(spark, sf, "documents")
    return search.corpus_stats(search.lengths(docs, search.postings(docs))).select("n", "total", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {bm25(BASE)} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 5")
def bm25_topk(spark, sf):
    return search.search(wide(spark, sf, "documents"), QUERY, 5, expand=False).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25(FULL)} SELECT doc_id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, doc_id LIMIT 20")
def bm25_expanded(spark, sf):
    return search.search(wide(spark, sf, "documents"), EXPANDED, 20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {tokens()} SELECT term, count(*)::BIGINT AS df, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM (SELECT DISTINCT term, doc_id FROM token) GROUP BY term")
def inverted_lists(spark, sf):
    return search.inverted_lists(search.postings(wide(spark, sf, "documents"))).select("term", "df", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"WITH {tokens()} SELECT (SELECT count(*) FROM documents)::BIGINT AS chunks, (SELECT count(DISTINCT source) FROM documents)::BIGINT AS files, (SELECT count(DISTINCT term) FROM token)::BIGINT AS terms, 5 AS version")
def index_status(spark, sf):
    docs = wide(spark, sf, "documents")
    terms = search.postings(docs).agg(F.countDistinct("term").alias("terms"))
    return docs.agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("files")).crossJoin(F.broadcast(terms)).withColumn("version", F.lit(search.VERSION))


@query(f"""WITH {bm25(BASE)}, best AS (SELECT doc_id, score * (1 + {' + '.join(f"""CASE WHEN contains(lower(source), '{t}') THEN 1.5 ELSE 0 END + CASE WHEN contains(lower(lang), '{t}') THEN 0.3 ELSE 0 END
  + CASE WHEN len(list_filter(string_split(text, ' ')[1:3], lambda x: contains(lower(x), '{t}'))) > 0 THEN 1 ELSE 0 END + CASE WHEN contains(lower(source), '{t}') OR contains(lower(lang), '{t}') THEN 0.5 ELSE 0 END
  + CASE WHEN contains(lower(source || '/st'), '{t}') THEN 1 ELSE 0 END""" for t in BASE + ['src1', 'st'])}) AS w FROM scored JOIN documents USING (doc_id))
SELECT doc_id, round(w, 6) AS score FROM best ORDER BY best.w DESC, doc_id LIMIT 10""")
def field_weighted_search(spark, sf):
    docs = wide(spark, sf, "documents")
    words = F.slice(F.split("text", " "), 1, 3)
    rows = search.query_scores(docs, BASE).join(docs, "doc_id")
    weight = search.field_weight([*BASE, "src1", "st"], F.col("source"), F.col("lang"), words, F.array("source", "lang"), F.concat("source", F.lit("/st")))
    rows = rows.select("doc_id", (F.col("score") * weight).alias("score"))
    return search.top_k(rows, 10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {bm25(BASE)} SELECT source, round(max(score), 6) AS score FROM scored JOIN documents USING (doc_id) GROUP BY source")
def max_score_per_source(spark, sf):
    docs = wide(spark, sf, "documents")
    best = catalog.best_per_group(search.query_scores(docs, BASE), docs, "source")
    return best.select("source", F.round("score", 6).alias("score"))


_HIT = " + ".join(f"CASE WHEN contains(lower(l), '{t}') THEN 1 ELSE 0 END" for t in ("reou", "hent"))


@query(f"""WITH line AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS l, ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
h AS (SELECT doc_id, i, l, {_HIT} AS h FROM line),
best AS (SELECT doc_id, max(h) AS m, min(i) FILTER (WHERE h = mx) AS b FROM (SELECT *, max(h) OVER (PARTITION BY doc_id) AS mx FROM h) GROUP BY doc_id),
doc AS (SELECT best.*, string_split(text, chr(10)) AS ls FROM best JOIN documents USING (doc_id)),
edge AS (SELECT *, coalesce((SELECT max(i) FROM unnest(range(1, b)) r(i) WHERE trim(ls[i]) IN ('', chr(125), chr(123)) OR starts_with(trim(ls[i]), '#')), 0) AS s,
  coalesce((SELECT min(i) FROM unnest(range(b, len(ls) + 1)) r(i) WHERE trim(ls[i]) = '' OR starts_with(trim(ls[i]), '#')), len(ls)) AS e FROM doc)
SELECT doc_id, md5(trim(array_to_string(CASE WHEN m = 0 THEN ls[1:6] WHEN e - s < 5 THEN ls[greatest(0, s - (5 - e + s) // 2) + 1:least(len(ls), e + (5 - e + s) // 2)] ELSE ls[s + 1:e] END, chr(10)), ' ' || chr(9) || chr(10))) AS digest FROM edge""")
def snippet(spark, sf):
    return wide(spark, sf, "documents").select("doc_id", F.md5(search.snippet(F.col("text"), ["reou", "hent"]).cast("binary")).alias("digest"))


@query(f"WITH {bm25(BASE)} SELECT doc_id, printf('%.2f', score) || ' ' || substr(text, 1, 1500) AS card FROM scored JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 3")
def result_cards(spark, sf):
    docs = wide(spark, sf, "documents")
    top = search.search(docs, QUERY, 3, expand=False)
    return top.join(docs, "doc_id").select("doc_id", F.concat(F.format_string("%.2f", "score"), F.lit(" "), F.substring("text", 1, 1500)).alias("card"))


@query("""SELECT coalesce(c.p, o.p) AS path, CASE WHEN c.p IS NULL THEN 'deleted' WHEN o.p IS NULL THEN 'new' WHEN c.t = o.t THEN 'unchanged' ELSE 'changed' END AS state
FROM (SELECT 'f' || doc_id AS p, n_chars AS t FROM documents WHERE doc_id % 7 <> 0) c
FULL JOIN (SELECT 'f' || doc_id AS p, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS t FROM documents WHERE doc_id % 11 <> 0) o ON c.p = o.p""")
def manifest_diff(spark, sf):
    docs = wide(spark, sf, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("mtime"))
    now, old = docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 11 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    return search.manifest_diff(now, old)


@query("SELECT 'f' || doc_id AS path, (doc_id % 5 = 0 OR doc_id % 11 = 0) AS fresh FROM documents WHERE doc_id % 7 <> 0")
def index_refresh(spark, sf):
    docs = wide(spark, sf, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("mtime"))
    now, old = docs.where("doc_id % 7 <> 0"), docs.where("doc_id % 11 <> 0").withColumn("mtime", F.col("mtime") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    chunk = lambda rows, fresh: rows.select("path", F.lit(fresh).alias("fresh"))
    return search.refresh(chunk(now, True), chunk(old, False), search.manifest_diff(now, old))


@query(f"WITH m AS (SELECT conv_id * 1000 + turn AS id, conv_id, role || ' ' || text AS body FROM conversations), {bm25(['assistant', 'thanoned'], 'm', 'id', 'body')} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 10")
def session_search(spark, sf):
    m = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws(" ", "role", "text").alias("body"))
    return search.search(m, "assistant thanoned", 10, expand=False, key="id", text="body").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {tokens()}, posting AS (SELECT DISTINCT term, doc_id FROM token), d AS (SELECT term, count(*) AS df FROM posting GROUP BY term)
SELECT p.term, d.df::BIGINT AS df, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS total, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS digest, true AS bounded FROM posting p JOIN d USING (term) GROUP BY ALL""")
def index_as_json(spark, sf):
    """The index's inverted blocks, written as JSON and read again: of every term its frequency and all ids, of which no block has more than eight."""
    folder = scratch(spark)
    search.export_json(search.postings(wide(spark, sf, "documents")), folder, 8)
    back = spark.read.schema("term string, block int, df long, ids array<long>").json(folder)
    ids = F.array_sort(F.flatten(F.collect_list("ids")))
    rows = back.groupBy("term", "df").agg(ids.alias("ids"), (F.max(F.size("ids")) <= 8).alias("bounded"), (F.count_distinct("block") == F.count("*")).alias("_one"))
    digest = F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary"))
    return rows.select("term", "df", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), digest.alias("digest"), (F.col("bounded") & F.col("_one")).alias("bounded"))


@query(f"""WITH {bm25(BASE)}, r AS (SELECT d.*, score, row_number() OVER (PARTITION BY lang ORDER BY scored.score DESC, d.doc_id) AS n FROM scored JOIN documents d USING (doc_id))
SELECT doc_id, md5('[Resultado ' || n || '] d/' || doc_id || ':1-' || len(string_split(text, chr(10))) || ' | score=' || printf('%.2f', score) || CASE WHEN doc_id % 2 = 0 THEN ' | «' || source || '»' ELSE '' END || ' (' || lang || ')' ||
  CASE WHEN doc_id % 3 > 0 THEN chr(10) || '  ── contexto ──' || chr(10) || substr(text, 1, 1500) || CASE WHEN length(text) > 1500 THEN chr(10) || '... [truncated]' ELSE '' END || chr(10) || '  ─────────────'
  ELSE chr(10) || '  ── texto ──' || chr(10) || substr(text, 1, 2000) || CASE WHEN length(text) > 2000 THEN chr(10) || '... [truncated]' ELSE '' END || chr(10) || '  ───────────' END) AS digest FROM r""")
def result_texts(spark, sf):
    """A card of every document that is found, ranked in its language; a third of them without a snippet."""
    docs, k = wide(spark, sf, "documents"), F.col("doc_id")
    found = search.query_scores(docs, BASE).join(docs, "doc_id")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "doc_id"))
    found = found.withColumn("_n", rank)
    card = search.result_card(F.col("_n"), F.concat(F.lit("d/"), k.cast("string")), F.lit(1), F.size(F.split("text", "\n")), F.col("score"), F.when(k % 2 == 0, F.col("source")), F.col("lang"), F.when(k % 3 > 0, F.col("text")), F.col("text"))
    return found.select("doc_id", F.md5(card.cast("binary")).alias("digest"))
