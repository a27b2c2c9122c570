"""Proportional stratified interleaving: shards of equal counts, each with the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Of the shuffle key, the first digits come from the text and the next ones from the row: together they name a range whose rows are ranked in one task.
TEXT_DIGITS, ROW_DIGITS = 3, 2
#: Ranges of the fractional rank.
BUCKETS = 4096


def _offsets(counts: DataFrame, by: list[str], bucket: str, total: str) -> DataFrame:
    """Rows before each bucket and in all, within by; counts has at most 16 ** (TEXT_DIGITS + ROW_DIGITS) rows a group."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn("_w_before", F.coalesce(F.sum("_w_n").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(total, F.sum("_w_n").over(w))


def interleave(docs: DataFrame, shards: int = 16, seed: str = "weftline", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Returns the columns of docs (without text) plus size, text_crc32, shard and slot.

    Rows of a source are shuffled by the first digits of md5(seed, crc32 of the
    text), then by md5(seed, id, crc32), ranked, and given the fractional rank
    (rank + 1/2) / rows of the source. All rows are put in the order of that
    fraction and cut into shards whose counts differ by one at most. Equal texts
    thus have nearly the same fraction in every source and share a shard, unless
    a cut falls among them or they are more than a shard holds; counts go first.
    Ranks come from counts of hash ranges plus a rank within a range, so
    a source with most of the rows never meets in one task. Texts are read once
    and the rest is written first. A null source is a source of its own; null
    text has size 1 and the crc32 of the empty text; a row with a null id
    shuffles by its place in docs; equal rows are interchangeable. Columns of
    docs named like the new ones give way. An empty table stays empty.
    """
    new = ("size", "text_crc32", "shard", "slot")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [c for c in docs.columns if c not in (*new, text_col)]
    rows = docs.select(
        *own,
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col(source_col).alias("_w_source"),
        F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.monotonically_increasing_id())).alias("_w_name"),
    )
    key = F.md5(F.concat_ws(":", F.lit(seed), "_w_name", "text_crc32").cast("binary"))
    group = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "text_crc32").cast("binary")), 1, TEXT_DIGITS)
    rows = cut(rows.withColumn("_w_md5", F.concat(group, key)).drop("_w_name")).withColumn("_w_bucket", F.substring("_w_md5", 1, TEXT_DIGITS + ROW_DIGITS))
    ties = ["_w_md5", "text_crc32", "size"]

    counts = rows.groupBy("_w_source", "_w_bucket").agg(F.count("*").alias("_w_n"))
    at = _offsets(counts, ["_w_source"], "_w_bucket", "_w_of").withColumnsRenamed({"_w_source": "_w_s", "_w_bucket": "_w_b"})
    ranked = rows.withColumn("_w_local", F.row_number().over(Window.partitionBy("_w_source", "_w_bucket").orderBy(*ties)))
    ranked = ranked.join(at, F.col("_w_source").eqNullSafe(F.col("_w_s")) & (F.col("_w_bucket") == F.col("_w_b")))
    ranked = ranked.select(*own, "size", "text_crc32", "_w_md5", ((F.col("_w_before") + F.col("_w_local") - 0.5) / F.col("_w_of")).alias("_w_fraction"))
    ranked = ranked.withColumn("_w_bucket", F.floor(F.col("_w_fraction") * BUCKETS).cast("int"))

    counts = ranked.groupBy("_w_bucket").agg(F.count("*").alias("_w_n"))
    at = _offsets(counts, [], "_w_bucket", "_w_all").withColumnRenamed("_w_bucket", "_w_b")
    placed = ranked.withColumn("_w_local", F.row_number().over(Window.partitionBy("_w_bucket").orderBy("_w_fraction", *ties)))
    placed = placed.join(F.broadcast(at), F.col("_w_bucket") == F.col("_w_b")).withColumn("_w_place", F.col("_w_before") + F.col("_w_local") - 1)
    shard = F.expr(f"(_w_place * {shards}) div _w_all")
    first = F.expr(f"(shard * _w_all + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(*own, "size", "text_crc32", "shard", (F.col("_w_place") - first).cast("long").alias("slot"))
