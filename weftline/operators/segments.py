"""An index in segments: a refresh reads only what changed, counts are sums over segments, and a merge puts them together again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import search
from weftline.operators.build import chunk_files
from weftline.sources import store
from weftline.sources.files import listed, sized, text_of, with_content
from weftline.sources.places import dealt

#: Each segment has these tables; chunks have the columns of chunk_code() and an id, sizes a chunk's terms too, so that what goes is counted by chunks.
TABLES = ("chunks", "postings", "sizes", "terms", "dropped")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime) of the files below root that are indexed; their bytes aren't read."""
    return sized(listed(spark, root)).select("path", "mtime")


def contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(path, mtime, text) of the wanted files below root; only their bytes are read."""
    files = sized(listed(spark, root)).join(wanted.select("path"), "path", "left_semi")
    return with_content(files, root).select("path", "mtime", text_of(F.col("content")).alias("text"))


def _tables(spark: SparkSession, folder: str, name: str, segments: list[str]) -> DataFrame:
    """One table of several segments, with the segment's name."""
    return spark.read.option("basePath", f"{folder}/{name}").parquet(*[f"{folder}/{name}/segment={s}" for s in segments])


def live_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, segment) of what the index holds."""
    return store.read(spark, folder)


def _numbers(sizes: DataFrame) -> tuple[int, int]:
    """Numbers of chunks and tokens."""
    return tuple(search.sizes_of(sizes).agg(F.count("*"), F.coalesce(F.sum("num_tokens"), F.lit(0))).first())


def _write_segment(chunks: DataFrame, folder: str, segment: str, removed: DataFrame | None) -> tuple[int, int]:
    """Writes a segment of chunks that also takes removed (id, segment) out of the others; gives what it adds to chunk and token numbers."""
    spark = chunks.sparkSession
    at = lambda name: f"{folder}/{name}/segment={segment}"
    chunks.write.parquet(at("chunks"))
    chunks = spark.read.schema(chunks.schema).parquet(at("chunks"))
    sizes = search.write_counts(dealt(chunks.select("id", "text")), at("sizes"), "id")
    search.write_inverted(sizes, at("postings"), "id")
    posted = spark.read.schema("term string, ids array<long>").parquet(at("postings"))
    df = posted.select("term", F.size("ids").cast("long").alias("df"))
    counts = _numbers(sizes)
    n, total = counts[0], counts[1]
    if removed is None:
        removed = spark.createDataFrame([], "id long, in_segment string")
    removed.write.parquet(at("dropped"))
    removed = spark.read.schema("id long, in_segment string").parquet(at("dropped"))
    old = [r[0] for r in removed.select("in_segment").distinct().collect()]
    if old:
        # What goes is counted off: the terms and sizes of the removed chunks, nothing else of the old segments.
        gone = removed.withColumnRenamed("in_segment", "segment")
        lost = _tables(spark, folder, "sizes", old).join(gone, ["id", "segment"], "left_semi")
        df = df.unionByName(lost.where(F.col("terms") != "").select(F.explode(search.terms_of()).alias("term"), F.lit(-1).cast("long").alias("df")))
        counts = _numbers(lost)
        n, total = n - counts[0], total - counts[1]
    df.groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") != 0).repartitionByRange("term").sortWithinPartitions("term").write.parquet(at("terms"))
    return n, total


def with_ids(chunks: DataFrame) -> DataFrame:
    """Names each chunk by its path and place, as a full build does."""
    return chunks.withColumn("id", F.xxhash64("path", "start", "end", "type", "name"))


def refresh(spark: SparkSession, folder: str, current: DataFrame, fetch: Callable[[DataFrame], DataFrame], chunker: Callable[[DataFrame], DataFrame] = chunk_files) -> dict[str, int]:
    """Brings the index in folder up to current, (path, mtime); gives the numbers of new, changed, deleted and unchanged files.

    fetch gives (path, mtime, text) of the files it is handed, (path): those that
    are new or have another time. Their chunks become a segment; chunks of
    changed and deleted files are taken out of the segments they are in. A
    first build is a refresh of nothing. A file without chunks is remembered, so
    that it isn't read again. The new state is one commit: a search sees the
    index before or after, and of two refreshes at once the later one fails.
    """
    base = (store.versions(spark, folder) or [0])[-1]
    known = store.notes(spark, folder, base) if base else {}
    if known and known["version"] != search.FORM:
        raise ValueError("the index has another version; build it again")
    old = store.read(spark, folder, base) if base else spark.createDataFrame([], "path string, mtime long, segment string")
    segment = uuid.uuid4().hex
    diff = search.manifest_diff(current, old)
    diff.write.parquet(f"{folder}/diffs/{segment}")
    diff = spark.read.schema("path string, state string").parquet(f"{folder}/diffs/{segment}")
    counts = {r["state"]: r["n"] for r in diff.groupBy("state").agg(F.count("*").alias("n")).collect()}
    out = {k: counts.get(k, 0) for k in ("new", "changed", "deleted", "unchanged")}
    if base and not out["new"] + out["changed"] + out["deleted"]:
        return out
    read = fetch(diff.where(F.col("state").isin("new", "changed")).select("path"))
    chunks = with_ids(chunker(read.select("path", "text")))
    removed = None
    if base:
        gone = old.join(diff.where(F.col("state").isin("changed", "deleted")), "path", "left_semi").select("path", "segment")
        removed = _tables(spark, folder, "chunks", known["segments"]).select("id", "path", "segment").join(gone, ["path", "segment"], "left_semi").select("id", F.col("segment").alias("in_segment"))
    n, total = _write_segment(chunks, folder, segment, removed)
    fresh = current.join(diff.where(F.col("state").isin("new", "changed")), "path", "left_semi").select("path", F.col("mtime").cast("long").alias("mtime"), F.lit(segment).alias("segment"))
    kept = old.join(diff.where(F.col("state") == "unchanged"), "path", "left_semi")
    notes = {"version": search.FORM, "segments": [*known.get("segments", []), segment], "n": known.get("n", 0) + n, "total": known.get("total", 0) + total}
    store.commit(spark, folder, kept.unionByName(fresh), base, notes)
    return out


def live(spark: SparkSession, folder: str, name: str, segments: list[str]) -> DataFrame:
    """The rows of a table by id, without those that a later segment took out."""
    dropped = _tables(spark, folder, "dropped", segments).select("id", F.col("in_segment").alias("segment"))
    return _tables(spark, folder, name, segments).join(dropped, ["id", "segment"], "left_anti")


def found(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """(id, score): BM25 of the index's chunks; the filter on terms reaches every segment's scan."""
    notes = store.notes(spark, folder)
    terms, segments = sorted(set(terms)), notes["segments"]
    of = lambda df: df.where(F.col("term").isin(terms)) if terms else df.limit(0)
    dropped = _tables(spark, folder, "dropped", segments).select("id", F.col("in_segment").alias("segment"))
    posted = of(search.flat(_tables(spark, folder, "postings", segments), "id", "segment")).join(dropped, ["id", "segment"], "left_anti")
    df = of(_tables(spark, folder, "terms", segments)).groupBy("term").agg(F.sum("df").alias("df"))
    sizes = search.sizes_of(_tables(spark, folder, "sizes", segments), "id", "segment")
    rows = posted.join(F.broadcast(df), "term").join(sizes, ["id", "segment"])
    tf = F.least(F.col("tf"), F.lit(search.MAX_TF))
    avgdl = notes["total"] / max(1, notes["n"])
    part = search.idf(F.lit(notes["n"]), F.col("df")) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * F.col("num_tokens") / F.lit(float(avgdl))))
    return rows.groupBy("id").agg(F.sum(part).alias("score")).where(F.col("score") > 0)


def search_segments(spark: SparkSession, folder: str, query: str, k: int = 5) -> DataFrame:
    """(path, start, end, type, name, score, text): the k best chunks, as search_index() of a full build gives them."""
    base = search.tokenize_query(query)
    segments = store.notes(spark, folder)["segments"]
    rows = found(spark, folder, search.expand_query(base)).join(live(spark, folder, "chunks", segments), "id")
    weight = search.field_weight(base, F.col("name"), F.col("type"), F.col("symbols"), F.col("imports"), F.col("parent"))
    return search.top_k(rows.withColumn("score", F.col("score") * weight), k, "id").select("path", "start", "end", "type", "name", "score", "text")


def compact(spark: SparkSession, folder: str) -> str:
    """Puts all segments into one without what was taken out; gives its name. Files aren't read, texts aren't tokenised again."""
    base = store.versions(spark, folder)[-1]
    notes = store.notes(spark, folder, base)
    segments, segment = notes["segments"], uuid.uuid4().hex
    at = lambda name: f"{folder}/{name}/segment={segment}"
    live(spark, folder, "chunks", segments).drop("segment").write.parquet(at("chunks"))
    live(spark, folder, "sizes", segments).drop("segment").write.parquet(at("sizes"))
    search.write_inverted(spark.read.parquet(at("sizes")), at("postings"), "id")
    df = _tables(spark, folder, "terms", segments).groupBy("term").agg(F.sum("df").alias("df")).where(F.col("df") != 0)
    df.repartitionByRange("term").sortWithinPartitions("term").write.parquet(at("terms"))
    spark.createDataFrame([], "id long, in_segment string").write.parquet(at("dropped"))
    files = store.read(spark, folder, base).withColumn("segment", F.lit(segment))
    store.commit(spark, folder, files, base, notes | {"segments": [segment]})
    return segment
