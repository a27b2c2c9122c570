"""Sections, paragraphs and chapters of whole texts, with SQL that walks lines and paragraphs its own way."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import chunking
from weftline.plans.registry import query, read, wide

_TRIM = "regexp_replace({}, '^[ \\t\\n\\x0b\\f\\r\\x{{85}}\\x{{a0}}]+|[ \\t\\n\\x0b\\f\\r\\x{{85}}\\x{{a0}}]+$', '', 'g')"
_CHAPTER = "(regexp_matches({0}, '(?i)^(chapter|capítulo|lección|lesson|unit|unidad|parte)\\s+\\d+') OR (strlen({0}) > 10 AND regexp_matches({0}, '^[A-ZÁÉÍÓÚÜÑ\\s]{{4,}}$')))"


def _lines(text: str) -> str:
    """CTEs from documents to line(doc_id, i, n, l, t): lines from 1, how many, plain and trimmed."""
    return f"""src AS (SELECT doc_id, {text} AS ls FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents)),
line AS (SELECT doc_id, i, n, l, {_TRIM.format("l")} AS t FROM (SELECT doc_id, len(ls) AS n, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM src))"""


def sections_sql(text: str, overlap: int = 50) -> str:
    return f"""WITH {_lines(text)},
mark AS (SELECT doc_id, i, CASE WHEN regexp_matches(t, '^(---|\\*\\*\\*|___)\\s*$') THEN '' WHEN t = '' THEN NULL WHEN regexp_matches(l, '^#{{1,6}}\\s+.+$') THEN regexp_extract(l, '^#{{1,6}}\\s+(.+)$', 1) WHEN {_CHAPTER.format("t")} THEN t
  WHEN strlen({_TRIM.format("regexp_extract(t, '^(?:[*]{1,3}|_{1,3})(.+)(?:[*]{1,3}|_{1,3})\\s*$', 1)")}) > 3 THEN {_TRIM.format("regexp_extract(t, '^(?:[*]{1,3}|_{1,3})(.+)(?:[*]{1,3}|_{1,3})\\s*$', 1)")} END AS name FROM line),
bound AS (SELECT doc_id, i, name FROM mark WHERE name IS NOT NULL UNION ALL SELECT doc_id, 1, '' FROM src WHERE doc_id NOT IN (SELECT doc_id FROM mark WHERE i = 1 AND name IS NOT NULL)),
cut AS (SELECT b.doc_id, b.i AS s, lead(b.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) - 1 AS stop, b.name, ls FROM bound b JOIN src USING (doc_id)),
part AS (SELECT doc_id, s, coalesce(stop, len(ls)) AS e, name, ls, {_TRIM.format("array_to_string(CASE WHEN stop IS NULL THEN ls[s:] ELSE ls[s:stop - 1] END, chr(10))")} AS c FROM cut),
kept AS (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS prev, count(*) OVER (PARTITION BY doc_id) AS many FROM part WHERE c <> '')
SELECT doc_id, s::INT AS start, e::INT AS "end", name, md5(CASE WHEN many > 1 THEN array_to_string(ls[greatest(s - {overlap}, 1, coalesce(prev, 1)):e], chr(10)) ELSE c END) AS digest FROM kept"""


def paragraphs_sql(text: str, size: int) -> str:
    return f"""WITH RECURSIVE p AS (SELECT doc_id, i, t, len(string_split(t, chr(10))) AS n FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, {_TRIM.format("unnest(ps)")} AS t FROM (SELECT doc_id, string_split({text}, chr(10) || chr(10)) AS ps FROM documents))),
f AS (SELECT doc_id, 0::BIGINT AS i, 1::BIGINT AS line, false AS pending, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS a, 0::BIGINT AS b, NULL::BIGINT AS ds, 0::BIGINT AS de, 0::BIGINT AS da, 0::BIGINT AS db FROM (SELECT DISTINCT doc_id FROM p) UNION ALL
  SELECT doc_id, i, CASE WHEN t = '' THEN line + 1 ELSE line + n + 1 END, CASE k WHEN 'blank' THEN pending ELSE k <> 'skip' END, CASE WHEN k = 'new' THEN line ELSE s END, CASE WHEN k IN ('new', 'merge') THEN line + n - 1 ELSE e END,
    CASE WHEN k = 'new' THEN i ELSE a END, CASE WHEN k IN ('new', 'merge') THEN i ELSE b END, CASE WHEN pending AND k IN ('new', 'skip') THEN s END, e, a, b
  FROM (SELECT f.doc_id, p.i, p.t, p.n, f.line, f.pending, f.s, f.e, f.a, f.b, CASE WHEN t = '' THEN 'blank' WHEN pending AND e - s + 1 + n <= {2 * size} THEN 'merge' WHEN n < 3 AND strlen(t) < 80 THEN 'skip' ELSE 'new' END AS k FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1)),
done AS (SELECT doc_id, ds AS s, de AS e, da AS a, db AS b FROM f WHERE ds IS NOT NULL UNION ALL SELECT f.doc_id, s, e, a, b FROM f JOIN (SELECT doc_id, max(i) AS i FROM p GROUP BY doc_id) m USING (doc_id, i) WHERE pending)
SELECT done.doc_id, s::INT AS start, e::INT AS "end", md5(string_agg(t, chr(10) || chr(10) ORDER BY p.i)) AS digest FROM done JOIN p ON p.doc_id = done.doc_id AND p.i BETWEEN a AND b AND t <> '' GROUP BY done.doc_id, s, e"""


def texts_sql(text: str) -> str:
    return f"""WITH {_lines(text)},
mark AS (SELECT doc_id, i, n, t FROM line WHERE {_CHAPTER.format("t")}),
chapter AS (SELECT * FROM (SELECT doc_id, i AS s, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, n) AS e, t AS name FROM mark) WHERE e + 1 - s > 5),
para AS (SELECT doc_id, i, {_TRIM.format("p")} AS p FROM (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT doc_id, string_split(array_to_string(ls, chr(10)), chr(10) || chr(10)) AS ps FROM src WHERE doc_id NOT IN (SELECT doc_id FROM chapter)))),
spot AS (SELECT *, len(string_split(p, chr(10))) - 1 AS k, 1 + coalesce(sum(len(string_split(p, chr(10))) - 1 + CASE WHEN strlen(p) < 50 THEN 2 ELSE 3 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM para),
long AS (SELECT * FROM spot WHERE strlen(p) >= 50),
win AS (SELECT doc_id, ls, unnest(range(0, greatest(0, ceil((len(ls) - 100) / 49))::BIGINT + 1)) * 49 + 1 AS s FROM src WHERE doc_id NOT IN (SELECT doc_id FROM chapter) AND doc_id NOT IN (SELECT doc_id FROM long))
SELECT doc_id, s::INT AS start, e::INT AS "end", 'chapter' AS type, md5(array_to_string(ls[s:e], chr(10))) AS digest FROM chapter JOIN src USING (doc_id)
UNION ALL SELECT doc_id, s::INT, (s + k)::INT, 'paragraph', md5(p) FROM long
UNION ALL SELECT doc_id, s::INT, least(s + 99, len(ls))::INT, 'code_block', md5(array_to_string(ls[s:least(s + 99, len(ls))], chr(10))) FROM win"""


_APART = "replace(text, '.' || chr(10), '.' || chr(10) || chr(10))"


def _spaced(spark, sf):
    return wide(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))


def _digest(rows, *columns):
    return rows.select("doc_id", "start", "end", *columns, F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(paragraphs_sql(_APART, 100))
def chunk_paragraph(spark, sf):
    return _digest(chunking.paragraphs(_spaced(spark, sf)))


@query(paragraphs_sql(_APART, 2))
def merged_paragraphs(spark, sf):
    """Paragraphs merged up to four lines, so that most texts have several and small ones are skipped."""
    return _digest(chunking.paragraphs(_spaced(spark, sf), 2))


@query(sections_sql("list_transform(ls, lambda l: CASE WHEN regexp_matches(l, '^\\w+\\.$') THEN '# ' || l ELSE l END)"))
def chunk_sections(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"(?m)^(\w+\.)$", "# $1").alias("text"))
    return _digest(chunking.sections(docs), "name")


#: Lines that become marks of all kinds, by their place: some next to each other, some with little between them.
_MARKED = {4: "---", 5: "## Heading {}", 7: "**Bold {}**", 9: "Chapter {} of it", 10: "ALL CAPITALS HERE", 12: "__no__"}
_MIXED = "list_transform(ls, lambda l, i: CASE " + " ".join(f"WHEN i % 13 = {k} THEN replace('{v}', '{{}}', i::VARCHAR)" for k, v in _MARKED.items()) + " ELSE l END)"


def _mixed(spark, sf):
    def line(x, i):
        out = None
        for k, v in _MARKED.items():
            mark = F.replace(F.lit(v), F.lit("{}"), (i + 1).cast("string"))
            out = F.when((i + 1) % 13 == k, mark) if out is None else out.when((i + 1) % 13 == k, mark)
        return out.otherwise(x)

    return read(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


@query(sections_sql(_MIXED))
def mixed_sections(spark, sf):
    """Every text with headings, rules, chapters, capitals and bold lines at fixed places."""
    return _digest(chunking.sections(_mixed(spark, sf)), "name")


@query(texts_sql("ls"))
def chunk_texts(spark, sf):
    return _digest(chunking.chunk_texts(read(spark, sf, "documents")), "type")


@query(texts_sql("""CASE doc_id % 3 WHEN 0 THEN list_transform(ls, lambda l, i: CASE WHEN i % 11 IN (2, 5) THEN 'Chapter ' || i ELSE l END)
WHEN 1 THEN string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10)) ELSE string_split(array_to_string(list_transform(ls, lambda l: substr(l, 1, 20)), chr(10) || chr(10)), chr(10)) END"""))
def mixed_texts(spark, sf):
    """A third of the texts with chapters, a third in paragraphs, a third with so short ones that windows are left."""
    lines, k = F.split("text", "\n"), F.col("doc_id") % 3
    chapters = F.array_join(F.transform(lines, lambda x, i: F.when(((i + 1) % 11).isin(2, 5), F.concat(F.lit("Chapter "), (i + 1).cast("string"))).otherwise(x)), "\n")
    short = F.array_join(F.transform(lines, lambda x: F.substring(x, 1, 20)), "\n\n")
    text = F.when(k == 0, chapters).when(k == 1, F.replace("text", F.lit(".\n"), F.lit(".\n\n"))).otherwise(short)
    return _digest(chunking.chunk_texts(read(spark, sf, "documents").select("doc_id", text.alias("text"))), "type")
