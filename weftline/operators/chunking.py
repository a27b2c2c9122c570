"""Chunkers: a row a document in, a row a chunk out (start and end are lines from 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import CAPITALS, CHAPTER, RULE, bind, section_header, trimmed


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _part(start: Column, end: Column, kind: str, name: Column, chunk: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("type"), name.alias("name"), chunk.alias("chunk"))


def _span(lines: Column, start: Column, end: Column) -> Column:
    """Lines from start to end, from 1, as a text."""
    return F.array_join(F.slice(lines, start.cast("int"), (end - start + 1).cast("int")), "\n")


def window_array(lines: Column, size: int = 30, overlap: int = 15) -> Column:
    """Windows of size lines as an array of parts; the next begins overlap lines before the last one's end, so the step is size - 1 - overlap."""
    if overlap >= size - 1:
        raise ValueError("overlap must be less than size - 1")
    step = size - 1 - overlap
    n = F.size(lines)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")

    def window(k: Column) -> Column:
        start = k * step + 1
        end = F.least(start + size - 1, n)
        return _part(start, end, "code_block", F.lit(""), _span(lines, start, end))

    return F.transform(F.sequence(F.lit(0), last), window)


def linear(df: DataFrame, size: int = 30, overlap: int = 15, text: str = "text", *keep: str) -> DataFrame:
    """Windows of size lines, a row each; see window_array()."""
    own = keep or [c for c in df.columns if c != text]
    rows = df.select(*own, lines_of(F.col(text)).alias("_lines"))
    return rows.select(*own, F.inline(window_array(F.col("_lines"), size, overlap))).drop("type", "name")


def with_overlap(chunks: DataFrame, lines: str, overlap: int, *key: str) -> DataFrame:
    """Chunks whose text also has up to overlap lines before it, but none before the last chunk's start; lone chunks stay."""
    w = Window.partitionBy(*key).orderBy("start")
    begin = F.greatest(F.col("start") - overlap, F.lit(1), F.coalesce(F.lag("start").over(w), F.lit(1)))
    several = F.count("*").over(Window.partitionBy(*key)) > 1
    return chunks.withColumn("chunk", F.when(several, F.array_join(F.slice(lines, begin, F.col("end") - begin + 1), "\n")).otherwise(F.col("chunk")))


def section_array(lines: Column, overlap: int = 50) -> Column:
    """Parts between headings and rules; a heading opens its own section.

    Before overlap is added a section's text lacks its last line, the one before
    the next boundary. Overlap puts up to so many lines before a section, but
    none before the last section's start; a lone section stays. Texts without a
    section give none; see paragraph_array().
    """

    def mark(line: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("start"), F.when(trimmed(line).rlike(RULE), "").otherwise(section_header(line)).alias("name"))

    first = F.array(F.struct(F.lit(1).alias("start"), F.lit("").alias("name")))
    found = F.filter(F.transform(lines, mark), lambda m: m["name"].isNotNull())
    bounds = bind(found, lambda ms: F.when(F.get(ms, F.lit(0))["start"] == 1, ms).otherwise(F.concat(first, ms)))

    def cut(bs: Column) -> Column:
        def part(m: Column, j: Column) -> Column:
            following = F.get(bs, j + 1)["start"]
            end = F.coalesce(following - 1, F.size(lines))
            return _part(m["start"], end, "section", m["name"], trimmed(_span(lines, m["start"], end - F.when(following.isNull(), 0).otherwise(1))))

        return F.filter(F.transform(bs, part), lambda p: p["chunk"] != "")

    def widened(ps: Column) -> Column:
        def wide(p: Column, j: Column) -> Column:
            begin = F.greatest(p["start"] - overlap, F.lit(1), F.coalesce(F.get(ps, j - 1)["start"], F.lit(1)))
            return _part(p["start"], p["end"], "section", p["name"], F.when(F.size(ps) > 1, _span(lines, begin, p["end"])).otherwise(p["chunk"]))

        return F.transform(ps, wide)

    parts = bind(bounds, cut)
    return bind(parts, widened) if overlap else parts


def sections(df: DataFrame, overlap: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, end, name, chunk): the parts of section_array(), a row each."""
    rows = df.select(key, lines_of(F.col(text)).alias("_lines"))
    return rows.select(key, F.inline(section_array(F.col("_lines"), overlap))).drop("type")


def paragraph_array(text: Column, size: int = 100) -> Column:
    """Blank-line paragraphs as parts, small ones merged up to twice size lines.

    A paragraph under three lines and 80 bytes is skipped unless one is pending.
    """
    kind = "array<struct<start:int,end:int,chunk:string>>"
    zero = F.struct(F.lit(1).alias("line"), F.lit(False).alias("open"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("chunk"), F.array().cast(kind).alias("done"))

    def step(a: Column, raw: Column) -> Column:
        p = trimmed(raw)
        n = F.size(F.split(p, "\n"))
        merged = a["open"] & (a["end"] - a["start"] + 1 + n <= 2 * size)
        flushed = F.when(a["open"], F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"), a["chunk"].alias("chunk"))))).otherwise(a["done"])
        skip = (n < 3) & (F.octet_length(p) < 80)
        make = lambda line, op, start, end, chunk, done: F.struct(line.alias("line"), op.alias("open"), start.alias("start"), end.alias("end"), chunk.alias("chunk"), done.alias("done"))
        line, last = a["line"], a["line"] + n - 1
        return (
            F.when(p == "", make(line + 1, a["open"], a["start"], a["end"], a["chunk"], a["done"]))
            .when(merged, make(line + n + 1, F.lit(True), a["start"], last, trimmed(F.concat(a["chunk"], F.lit("\n\n"), p)), a["done"]))
            .when(skip, make(line + n + 1, F.lit(False), F.lit(0), F.lit(0), F.lit(""), flushed))
            .otherwise(make(line + n + 1, F.lit(True), line, last, p, flushed))
        )

    finish = lambda a: F.when(a["open"], F.concat(a["done"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"), a["chunk"].alias("chunk"))))).otherwise(a["done"])
    return F.transform(F.aggregate(F.split(text, "\n\n"), zero, step, finish), lambda p: _part(p["start"], p["end"], "paragraph", F.lit(""), p["chunk"]))


def paragraphs(df: DataFrame, size: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, end, chunk): the parts of paragraph_array(), a row each."""
    return df.select(key, F.inline(paragraph_array(F.col(text), size))).drop("type", "name")


def chapter_array(lines: Column) -> Column:
    """Chapters of six lines or more as parts, from a chapter line to the next; text before the first goes."""

    def mark(line: Column, i: Column) -> Column:
        t = trimmed(line)
        return F.struct((i + 1).alias("start"), F.when(t.rlike(CHAPTER) | ((F.octet_length(t) > 10) & t.rlike(CAPITALS)), t).alias("name"))

    def cut(ms: Column) -> Column:
        end = lambda j: F.coalesce(F.get(ms, j + 1)["start"] - 1, F.size(lines))
        parts = F.transform(ms, lambda m, j: F.struct(m["start"].alias("start"), end(j).alias("end"), m["name"].alias("name")))
        long = F.filter(parts, lambda p: p["end"] + 1 - p["start"] > 5)
        return F.transform(long, lambda p: _part(p["start"], p["end"], "chapter", p["name"], _span(lines, p["start"], p["end"])))

    return bind(F.filter(F.transform(lines, mark), lambda m: m["name"].isNotNull()), cut)


def chapters(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, end, name, chunk): the parts of chapter_array(), a row each."""
    rows = df.select(key, lines_of(F.col(text)).alias("_lines"))
    return rows.select(key, F.inline(chapter_array(F.col("_lines")))).drop("type")


def text_paragraph_array(text: Column) -> Column:
    """Paragraphs of 50 bytes or more as parts; line numbers count two more a paragraph, as the original does."""
    breaks = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    after = lambda p: breaks(p) + F.when(F.octet_length(p) < 50, 2).otherwise(3)

    def cut(ps: Column) -> Column:
        zero = F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("at"))
        step = lambda a, p: F.struct((a["line"] + after(p)).alias("line"), F.concat(a["at"], F.array(a["line"])).alias("at"))
        starts = F.aggregate(ps, zero, step, lambda a: a["at"])
        both = F.zip_with(starts, ps, lambda at, p: _part(at, at + breaks(p), "paragraph", F.lit(""), p))
        return F.filter(both, lambda x: F.octet_length(x["chunk"]) >= 50)

    return bind(F.transform(F.split(text, "\n\n"), trimmed), cut)


def text_paragraphs(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, end, chunk): the parts of text_paragraph_array(), a row each."""
    return df.select(key, F.inline(text_paragraph_array(F.col(text)))).drop("type", "name")


def first_filled(*arrays: Column) -> Column:
    """The first array that isn't empty, else the last; those after it aren't computed."""
    if len(arrays) == 1:
        return arrays[0]
    return bind(arrays[0], lambda x: F.when(F.size(x) > 0, x).otherwise(first_filled(*arrays[1:])))


def text_array(lines: Column, text: Column) -> Column:
    """A plain text's chapters, else its paragraphs, else windows of 100 lines with 50 of overlap."""
    return first_filled(chapter_array(lines), text_paragraph_array(text), window_array(lines, 100, 50))


def markdown_array(lines: Column, text: Column) -> Column:
    """A Markdown text's sections, else its paragraphs, else windows of 100 lines with 50 of overlap."""
    return first_filled(section_array(lines), paragraph_array(text), window_array(lines, 100, 50))


def chunk_texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, end, type, name, chunk) by text_array(), in one pass."""
    rows = df.select(key, F.col(text).alias("_text"), lines_of(F.col(text)).alias("_lines"))
    return rows.select(key, F.inline(text_array(F.col("_lines"), F.col("_text"))))
