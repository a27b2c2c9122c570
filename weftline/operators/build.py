"""From files to an index: scan, chunk by kind of file, save."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import chunking, search
from weftline.operators.code import SCHEMA, chunk_code
from weftline.sources.files import scan, text_of

MARKDOWN, PLAIN = ("md", "mdx"), ("txt",)


def chunk_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Chunks of files by extension, in the columns of chunk_code().

    Markdown is cut at its sections, else into paragraphs, else into windows of
    lines; plain text at its chapters, else paragraphs, else windows; all others
    go to chunk_code(). Files without a path or text give none.
    """
    rows = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where(F.col("path").isNotNull() & F.col("text").isNotNull())
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    marked, plain = rows.where(ext.isin(*MARKDOWN)), rows.where(ext.isin(*PLAIN))
    out = chunk_code(rows.where(~ext.isin(*MARKDOWN, *PLAIN)))
    none = F.array().cast("array<string>")
    for part, cut, lang in ((marked, chunking.markdown_array, "markdown"), (plain, chunking.text_array, "text")):
        parts = part.select("path", "text", chunking.lines_of(F.col("text")).alias("_lines")).select("path", F.inline(cut(F.col("_lines"), F.col("text"))))
        out = out.unionByName(parts.select("path", "start", "end", "type", "name", F.lit("").alias("parent"), none.alias("imports"), none.alias("symbols"), F.lit(lang).alias("lang"), F.col("chunk").alias("text")))
    return out


def build_index(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """Scans the files below root, chunks them, and saves chunks and index to folder; gives the chunks with their ids.

    A chunk's id is a hash of its path and place, so that a later build names unchanged ones alike.
    """
    files = scan(spark, root).select("path", "mtime", text_of(F.col("content")).alias("text"))
    chunks = chunk_files(files).withColumn("id", F.xxhash64("path", "start", "end", "type", "name"))
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    search.save(chunks, folder, "id")
    files.select("path", "mtime").write.mode("overwrite").parquet(f"{folder}/manifest")
    return chunks


def search_index(spark: SparkSession, folder: str, query: str, k: int = 5) -> DataFrame:
    """(path, start, end, type, name, score, text): the k best chunks of a saved index, fields weighed in."""
    posted, sizes, stats = search.load(spark, folder)
    base = search.tokenize_query(query)
    found = search.scores(posted, sizes, stats, search.expand_query(base), "id").join(spark.read.parquet(f"{folder}/chunks"), "id")
    weight = search.field_weight(base, F.col("name"), F.col("type"), F.col("symbols"), F.col("imports"), F.col("parent"))
    return search.top_k(found.withColumn("score", F.col("score") * weight), k, "id").select("path", "start", "end", "type", "name", "score", "text")


__all__ = ["SCHEMA", "build_index", "chunk_files", "search_index"]
