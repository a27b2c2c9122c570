"""Benchmark decontamination: find, in training text, windows of words of benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, cut, row_key, words

#: Windows broadcast with their words (about 300 bytes each, 150 MB); a larger set is filtered for by a bitmap and joined by hash.
BROADCAST_WINDOWS = 500_000
#: Bits of that bitmap: 16 a window, this many (16 MB) at most.
BITMAP_BITS = 1 << 27
#: A window that very many texts hold is joined in so many places.
SALTS = 16


def _gram(words: Column, start: Column, width: int) -> Column:
    """64-bit hash of width words from start on."""
    return F.xxhash64(F.lit(width), *[F.get(words, start + k) for k in range(width)])


def benchmark_windows(benchmark: DataFrame, width: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(_hash, _window, _items): each distinct run of width consecutive words of an item, or all its words if fewer.

    Null and wordless items have none, repeated items one; a null id is no item,
    though its windows are there. Other columns are not read; an empty table
    gives an empty one.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("_item"), words(F.col(text_col)).alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - width + 1, F.lit(1)))
    windows = items.select("_item", F.explode(F.transform(starts, lambda i: F.slice("_words", i, width))).alias("_window"))
    gram = F.coalesce(*[F.when(F.size("_window") == n, _gram(F.col("_window"), F.lit(0), n)) for n in range(1, width + 1)])
    return windows.groupBy("_window").agg(F.collect_set("_item").alias("_items")).select(gram.alias("_hash"), "_window", "_items")


def _bitmap(windows: DataFrame, n: int, most: int) -> tuple[DataFrame, int]:
    """One row with a bitmap of the hashes, as an array of longs, and its number of bits."""
    bits = min(most, 1 << max(6, (16 * n - 1).bit_length()))
    place = F.col("_hash").bitwiseAND(bits - 1)
    ones = windows.groupBy(F.shiftright(place, 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_hash & 63 as int))")).alias("_b"))
    every = windows.sparkSession.range(bits // 64).select(F.col("id").alias("_word")).join(ones, "_word", "left")
    pairs = F.array_sort(F.collect_list(F.struct("_word", F.coalesce("_b", F.lit(0).cast("long")).alias("_b"))))
    return every.agg(F.transform(pairs, lambda x: x["_b"]).alias("_bits")), bits


def _hits(docs: DataFrame, windows: DataFrame, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(key, start, length, items) of the occurrences.

    Every run of words of a text is hashed and looked up in the broadcast set of
    window hashes, and where it is found, the words are compared. The words stay
    beside the exploded places; generated code passes a reference, so only rows
    that meet a window are ever built. A set over BROADCAST_WINDOWS still takes
    one pass: a broadcast bitmap lets few other runs through, and these are
    joined by hash, salted.
    """
    widths = sorted(r["n"] for r in windows.select(F.size("_window").alias("n")).distinct().collect())
    texts = docs.select(*row_key(id_col, text_col), words(F.col(text_col)).alias("_words"))
    at = texts.select(*KEY, "_words", F.posexplode("_words").alias("_start", "_word"))
    grams = [F.struct(F.lit(n).alias("_len"), _gram(F.col("_words"), F.col("_start"), n).alias("_hash")) for n in widths]
    at = at.select(*KEY, "_words", "_start", *([grams[0]["_len"].alias("_len"), grams[0]["_hash"].alias("_hash")] if len(widths) == 1 else [F.inline(F.array(*grams))]))
    if rows > BROADCAST_WINDOWS:
        bitmap, bits = _bitmap(windows, rows, BITMAP_BITS)
        at = at.crossJoin(F.broadcast(bitmap))  # one row
        word = F.get("_bits", F.shiftright(F.col("_hash").bitwiseAND(bits - 1), 6).cast("int"))
        at = at.withColumn("_w_word", word).where(F.expr("(shiftright(_w_word, cast(_hash & 63 as int)) & 1) = 1"))
        at = at.select(*KEY, F.slice("_words", F.col("_start") + 1, F.col("_len")).alias("_text"), "_start", "_len", "_hash", F.pmod(F.xxhash64(*KEY, "_start"), F.lit(SALTS)).cast("int").alias("_salt"))
        windows = windows.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = at.join(windows, ["_hash", "_salt"]).where(F.col("_text") == F.col("_window"))
    else:
        found = at.join(F.broadcast(windows), "_hash").where(F.slice("_words", F.col("_start") + 1, F.col("_len")) == F.col("_window"))
    return found.select(*KEY, "_start", "_len", "_items")


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Returns docs plus n_words, n_hit, items (sorted strings) and spans ([start, end) of words).

    A word inside any occurrence of a window is hit. Null or empty text has no
    words; null or wordless items have no windows; a null item_id is not
    reported as an item, though its windows count; items that repeat count once.
    Columns of docs named like the new ones give way. Empty tables on either
    side find nothing.
    """
    new = ["n_words", "n_hit", "items", "spans"]
    windows = cut(benchmark_windows(benchmark, width, item_col, item_text_col))
    n_windows = windows.count()
    own = [c for c in docs.columns if c not in new]
    rows = docs.select(*own, *row_key(id_col, text_col), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start:int,end:int>>")}
    if not n_windows:
        return rows.select(*own, "n_words", *[v.alias(k) for k, v in none.items()])
    hits = _hits(docs, windows, n_windows, id_col, text_col)
    w = Window.partitionBy(*KEY).orderBy("_start", "_end")
    spans = hits.groupBy(*KEY, "_start", (F.col("_start") + F.col("_len")).alias("_end")).agg(F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items"))
    spans = spans.withColumn("_reach", F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("_span", F.sum(F.when(F.col("_start") <= F.col("_reach"), 0).otherwise(1)).over(w))
    spans = spans.groupBy(*KEY, "_span").agg(F.min("_start").alias("start"), F.max("_end").alias("end"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    spans = spans.groupBy(*KEY).agg(
        F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("items"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    return rows.join(spans, KEY, "left").select(*own, "n_words", *[F.coalesce(F.col(k), v).alias(k) for k, v in none.items()])


def remove_spans(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of scan() with hit words, and what separates them from the next word, cut out of the text."""
    text, spans = F.coalesce(F.col(text_col), F.lit("")), F.col("spans")
    units = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[^0-9A-Za-z\x{80}-\x{10FFFF}]*"), F.lit(0))
    lead = F.regexp_extract(text, r"^[^0-9A-Za-z\x{80}-\x{10FFFF}]*", 0)
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    end = lambda i: F.when(i == F.size(spans), F.size(units)).otherwise(F.get(spans, i)["start"])
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.slice(units, begin(i) + 1, end(i) - begin(i))))
    return scanned.withColumn(text_col, F.when(F.size(spans) == 0, F.col(text_col)).otherwise(F.concat(lead, F.array_join(kept, ""))))


def remove_documents(scanned: DataFrame) -> DataFrame:
    """The rows of scan() without a hit."""
    return scanned.where(F.col("n_hit") == 0)
