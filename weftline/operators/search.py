"""Lexical index and BM25 search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from weftline.functions.text import bind, count_terms, countable, expand_query, token_rows, tokenize_query
from weftline.sources import store

K1, B, VERSION = 1.5, 0.75, 5
#: What a saved index's notes say of its tables' form, beside its version.
FORM = [VERSION, "blocks"]
MAX_TF = 65_535
#: Parts that a term's ids are numbered in.
PARTS = 16
#: Documents that are counted at a time, and postings that are put in order at a time, in a task.
COUNTED, INVERTED = 2_000, 1_000_000


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, num_tokens, terms, tfs): a row a document, with its distinct terms, joined by spaces, and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, COUNTED):
                part = batch.slice(lo, COUNTED)
                sizes, terms, tfs = count_terms(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pc.binary_join(terms, " "), tfs], names=names)

    names = [key, "num_tokens", "terms", "tfs"]
    kinds = [docs.schema[key].dataType, t.LongType(), t.StringType(), t.ArrayType(t.IntegerType())]
    return docs.select(key, countable(F.col(text)).alias("_text")).mapInArrow(run, t.StructType([t.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def write_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes counted() of documents and gives it as read again.

    Where several documents have one key, each has the tokens of all of them as
    its number and no terms, and a row without a number has the terms.
    """
    spark, raw = docs.sparkSession, f"{path}-raw"
    counted(docs, key, text).write.mode("overwrite").parquet(raw)
    counts = spark.read.parquet(raw)
    fs, old = store._fs(spark, raw)
    several = counts.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"), F.sum("num_tokens").alias("_sum")).where((F.col("_n") > 1) | F.col("_k").isNull())
    if several.isEmpty():
        new = store._fs(spark, path)[1]
        fs.delete(new, True)
        fs.rename(old, new)
    else:
        same = F.col(key).eqNullSafe(F.col("_k"))
        rows = counts.join(several, same, "left")
        alone = F.col("_n").isNull()
        own = [F.when(alone, F.col("terms")).otherwise("").alias("terms"), F.when(alone, F.col("tfs")).otherwise(F.array().cast("array<int>")).alias("tfs")]
        number = F.when(alone, F.col("num_tokens")).otherwise(F.when(F.col(key).isNull(), 0).otherwise(F.col("_sum")))
        terms = counts.join(several, same, "left_semi").select(key, F.inline(F.arrays_zip(terms_of().alias("terms"), "tfs")).alias("term", "tf")).where(F.col("term") != "").groupBy(key, "term").agg(F.sum("tf").cast("int").alias("tf"))
        pairs = terms.groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("p"))
        joined = pairs.select(key, F.lit(None).cast("long").alias("num_tokens"), F.array_join("p.term", " ").alias("terms"), F.col("p.tf").alias("tfs"))
        rows.select(key, number.alias("num_tokens"), *own).unionByName(joined).write.mode("overwrite").parquet(path)
        fs.delete(old, True)
    return spark.read.schema(counts.schema).parquet(path)


def terms_of() -> Column:
    """The terms of a row of write_counts()."""
    return F.split("terms", " ")


def sizes_of(counts: DataFrame, *keep: str) -> DataFrame:
    """(keep..., num_tokens) of every document of write_counts()."""
    return counts.where(F.col("num_tokens").isNotNull()).select(*keep, "num_tokens")


def inverted(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, ids, tfs): counted() turned round, a term in as many rows as parts of the table have it; see flat()."""

    def turned(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()
        for batch in table:
            ids, terms, tfs = batch.columns
            terms = pc.split_pattern(terms, " ")
            words = terms.flatten().dictionary_encode()
            codes = words.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
            ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))]).astype("int32")
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (ids.take(pa.array(rows[order])), tfs.flatten().take(pa.array(order)))]
            out = pa.RecordBatch.from_arrays([words.dictionary, *lists], names=["term", "ids", "tfs"])
            for lo in range(0, out.num_rows, 10_000):
                yield out.slice(lo, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, COUNTED):
                parts.append(batch.slice(lo, COUNTED))
                n += len(parts[-1].column(2).flatten())
                if n >= INVERTED:
                    yield from turned(parts)
                    parts, n = [], 0
        if n:
            yield from turned(parts)

    schema = t.StructType([t.StructField("term", t.StringType()), t.StructField("ids", t.ArrayType(counts.schema[key].dataType)), t.StructField("tfs", t.ArrayType(t.IntegerType()))])
    return counts.select(key, "terms", "tfs").where(F.col("terms") != "").mapInArrow(run, schema)


def write_inverted(counts: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes inverted() ranged by term, so that a search reads few row groups."""
    inverted(counts, key).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def flat(blocks: DataFrame, key: str = "doc_id", *keep: str) -> DataFrame:
    """(term, keep..., key, tf) of inverted(), a row a posting; a filter on terms reaches the blocks' scan."""
    rows = blocks.select("term", *keep, F.inline(F.arrays_zip("ids", "tfs")).alias(key, "tf"))
    return rows.withColumn("tf", F.col("tf").cast("long"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf)."""
    return token_rows(docs, F.col(text), key).groupBy("term", key).agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, posted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, num_tokens) of every document, those without a token too."""
    return docs.select(key).join(posted.groupBy(key).agg(F.sum("tf").alias("num_tokens")), key, "left").fillna(0, ["num_tokens"])


def corpus_stats(sizes: DataFrame) -> DataFrame:
    """One row: n, total, avgdl, k1, b, version."""
    return sizes.agg(F.count("*").alias("n"), F.sum("num_tokens").alias("total"), F.avg("num_tokens").alias("avgdl")).withColumns({"k1": F.lit(K1), "b": F.lit(B), "version": F.lit(VERSION)})


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_stats(posted: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf)."""
    counts = posted.groupBy("term").agg(F.count("*").alias("df"))
    return counts.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def inverted_lists(posted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, df, ids): an array a term; only for indexes whose lists fit a row."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.array_sort(F.collect_list(key)).alias("ids"))


def inverted_blocks(posted: DataFrame, size: int = 1024, key: str = "doc_id") -> DataFrame:
    """(term, block, df, ids): a term's ids in order, size of them a row, so that no list grows with the corpus.

    A term with many ids is numbered in parts of its ids' hash range, each part
    by itself; the parts' blocks follow one another.
    """
    rows = posted.select("term", key).withColumn("_p", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    own = Window.partitionBy("term", "_p").orderBy(key)
    rows = rows.withColumn("_b", F.floor((F.row_number().over(own) - 1) / size))
    blocks = rows.groupBy("term", "_p", "_b").agg(F.array_sort(F.collect_list(key)).alias("ids"))
    block = (F.row_number().over(Window.partitionBy("term").orderBy("_p", "_b")) - 1).cast("int")
    df = F.sum(F.size("ids")).over(Window.partitionBy("term"))  # of the blocks, so that postings are made and dealt out once
    return blocks.select("term", block.alias("block"), df.alias("df"), "ids")


def export_json(posted: DataFrame, path: str, size: int = 1024, key: str = "doc_id") -> None:
    """Writes an index's inverted blocks as JSON lines that a person can read."""
    inverted_blocks(posted, size, key).write.mode("overwrite").json(path)


# What stands around a card's snippet, and around its text where it has none.
CARD_SNIPPET = ("  ── contexto ──", "  ─────────────", 1500)
CARD_TEXT = ("  ── texto ──", "  ───────────", 2000)
CARD_CUT = "\n... [truncated]"


def result_card(rank: Column, path: Column, start: Column, end: Column, score: Column, name: Column, lang: Column, shown: Column, text: Column) -> Column:
    """A result as text: where it stands, its score with two places, name and language if any, and its snippet, else its text, both cut."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    head = F.concat(F.lit("[Resultado "), rank.cast("string"), F.lit("] "), path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" | score="), F.format_string("%.2f", score))
    head = F.concat(head, F.when(has(name), F.concat(F.lit(" | «"), name, F.lit("»"))).otherwise(""), F.when(has(lang), F.concat(F.lit(" ("), lang, F.lit(")"))).otherwise(""))

    def block(c: Column, around: tuple[str, str, int]) -> Column:
        before, after, most = around
        cut = F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(CARD_CUT))).otherwise(c)
        return F.concat(F.lit(f"\n{before}\n"), cut, F.lit(f"\n{after}"))

    return F.concat(head, F.when(has(shown), block(shown, CARD_SNIPPET)).when(has(text), block(text, CARD_TEXT)).otherwise(""))


def scores(posted: DataFrame, sizes: DataFrame, stats: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """(key, score): BM25 over the documents that hold a term.

    The filter on terms reaches the scan of a stored postings table; only its
    rows are joined, and stats is one row.
    """
    found = posted.where(F.col("term").isin(sorted(set(terms)))) if terms else posted.limit(0)
    found = found.join(F.broadcast(found.groupBy("term").agg(F.count("*").alias("df"))), "term").join(sizes, key).crossJoin(F.broadcast(stats))
    tf = F.least(F.col("tf"), F.lit(MAX_TF))  # as the reference packs it
    part = idf(F.col("n"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("num_tokens") / F.col("avgdl")))
    return found.groupBy(key).agg(F.sum(part).alias("score")).where(F.col("score") > 0)


def top_k(scored: DataFrame, k: int = 5, key: str = "doc_id", most: int = 20) -> DataFrame:
    """The k best (at most `most`), ties by key."""
    return scored.orderBy(F.desc("score"), key).limit(min(k, most))


def query_scores(docs: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): BM25 of terms over unindexed documents.

    One pass over the texts: a document's tokens are counted where it is read, and
    only its length and the counts of the query's terms are shuffled.
    """
    terms = sorted(set(terms))
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    rows = token_rows(docs, F.col(text), key, outer=True)
    sizes = rows.groupBy(key).agg(F.count("term").alias("num_tokens"), *[F.count_if(F.col("term") == t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    stats = sizes.agg(F.count("*").alias("n"), F.avg("num_tokens").alias("avgdl"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    total = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.least(F.col(f"_tf{i}"), F.lit(MAX_TF))
        total = total + idf(F.col("n"), F.col(f"_df{i}")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("num_tokens") / F.col("avgdl")))
    some = sizes.where(F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))], F.lit(0)) > 0)
    return some.crossJoin(F.broadcast(stats)).select(key, total.alias("score")).where(F.col("score") > 0)


def search(docs: DataFrame, query: str, k: int = 5, expand: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of a query over unindexed documents; a stored index is served by load() and scores()."""
    base = tokenize_query(query)
    return top_k(query_scores(docs, expand_query(base) if expand else base, key, text), k, key)


def to_json(found: DataFrame, order: str = "score", by: str | None = None) -> DataFrame:
    """One row, json: the results as an array, best first; [] for none. With by, a row and an array for each of its values, without that column."""
    own = [c for c in found.columns if c != by]
    rows = F.array_sort(F.collect_list(F.struct((-F.col(order)).alias("_o"), F.struct(*own).alias("_r"))))
    return found.groupBy(*([by] if by else [])).agg(F.to_json(F.transform(rows, lambda x: x["_r"])).alias("json"))


def field_weight(tokens: list[str], name: Column, kind: Column, symbols: Column, imports: Column, parent: Column) -> Column:
    """1, and for each query token more for each field that contains it: name 1.5, type 0.3, a symbol 1, an import 0.5, parent 1."""
    weight = F.lit(1.0)
    for t in tokens:
        for test, gain in ((_has(name, t), 1.5), (_has(kind, t), 0.3), (_inside(symbols, t), 1.0), (_inside(imports, t), 0.5), (_has(parent, t), 1.0)):
            weight = weight + F.when(test, gain).otherwise(0.0)
    return weight


def _has(c: Column, token: str) -> Column:
    return F.coalesce(F.lower(c).contains(token), F.lit(False))


def _inside(xs: Column, token: str) -> Column:
    return F.exists(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.lower(x).contains(token))


def snippet(text: Column, tokens: list[str], context: int = 5) -> Column:
    """The block around the line with most tokens, from a break to the next, at least about context lines."""
    hits_of = lambda x: bind(F.lower(x), lambda y: sum((F.contains(y, F.lit(t)).cast("int") for t in tokens), F.lit(0)))
    stops = lambda x: bind(F.trim(x), lambda y: (y == "") | F.startswith(y, F.lit("#")) | F.startswith(y, F.lit("```")))
    walls = lambda x: stops(x) | F.trim(x).isin("}", "{")

    def cut(lines: Column, most: Column, best: Column) -> Column:
        n = F.size(lines)
        back = F.array_max(F.filter(F.transform(F.slice(lines, 1, best), lambda x, i: F.when(walls(x), i + 1)), lambda i: i.isNotNull()))
        on = F.array_min(F.filter(F.transform(F.slice(lines, best + 1, n), lambda x, i: F.when(stops(x), i + 1)), lambda i: i.isNotNull()))

        def block(start: Column, end: Column) -> Column:
            extra, small = F.floor((context - (end - start)) / 2).cast("int"), end - start < context
            lo, hi = F.when(small, F.greatest(F.lit(0), start - extra)).otherwise(start), F.when(small, F.least(n, end + extra)).otherwise(end)
            return F.slice(lines, lo + 1, hi - lo)

        found = bind(F.coalesce(back, F.lit(0)), lambda start: bind(F.coalesce(best + on, n), lambda end: block(start, end)))
        return F.array_join(F.when(most > 0, found).otherwise(F.slice(lines, 1, context + 1)), "\n")

    def of(lines: Column) -> Column:
        at = lambda hits: bind(F.array_max(hits), lambda most: cut(lines, most, (F.array_position(hits, most) - 1).cast("int")))
        return bind(F.transform(lines, hits_of), at)

    return F.regexp_replace(bind(F.split(text, "\n"), of), r"^\s+|\s+$", "")


# Persistence and refresh


def save(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes sizes with each document's terms, postings in blocks, and stats."""
    counts = write_counts(docs, f"{path}/sizes", key, text)
    write_inverted(counts, f"{path}/postings", key)
    corpus_stats(sizes_of(counts)).write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, sizes, stats) of a saved index; refuses another version."""
    stats, blocks = spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/postings")
    if stats.first()["version"] != VERSION or "ids" not in blocks.columns:
        raise ValueError("the index has another version; build it again")
    counts = spark.read.parquet(f"{path}/sizes")
    return flat(blocks, counts.columns[0]), sizes_of(counts, counts.columns[0]), stats


def manifest_diff(current: DataFrame, old: DataFrame, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """(path, state): unchanged with the same time, changed, new, or deleted."""
    both = current.select(path, F.col(mtime).alias("_now")).join(old.select(path, F.col(mtime).alias("_then")), path, "full")
    state = F.when(F.col("_now").isNull(), "deleted").when(F.col("_then").isNull(), "new").when(F.col("_now") == F.col("_then"), "unchanged").otherwise("changed")
    return both.select(path, state.alias("state"))


def refresh(chunks: DataFrame, old_chunks: DataFrame, diff: DataFrame, path: str = "path") -> DataFrame:
    """New chunks of new and changed paths, and the old ones of unchanged paths."""
    kept = old_chunks.join(diff.where(F.col("state") == "unchanged"), path, "left_semi")
    return chunks.join(diff.where(F.col("state").isin("new", "changed")), path, "left_semi").unionByName(kept)
