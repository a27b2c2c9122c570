"""Line deduplication: drop lines whose normalised form occurs in many documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, KEY, ascii_lower, cut, row_key, spread_join

#: 16 bytes a key: at most 32 MB is ever broadcast; more frequent lines than that are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def _line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes name a line."""
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(11), key).alias("_h2")]


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text") -> DataFrame:
    """(_h1, _h2, n_docs) of the line keys of at least min_chars code points in at least min_docs rows.

    A key counts once a row, so the count is map-side combined and a line that
    all documents share costs one row a task.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    keys = docs.select(F.explode(F.array_distinct(F.transform(lines, _line_key))).alias("_key")).where(F.char_length("_key") >= min_chars)
    return keys.groupBy(*_hashes(F.col("_key"))).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns docs with frequent lines removed from text_col, plus n_lines and n_dropped.

    Null and empty text is one empty line and comes back as the empty text.
    Every row counts as a document, so a repeated row counts again. Lines that
    stay keep their order and their bytes. Columns of docs named n_lines or
    n_dropped give way; all others stay. An empty table gives an empty table.
    A repeated id is as many documents as rows. More frequent lines than
    BROADCAST_KEYS are joined by hash, the commonest dealt to several tasks.
    """
    hot = cut(frequent_lines(docs, min_docs, min_chars, text_col).select("_h1", "_h2", F.col("n_docs").alias("_n")))
    n_hot, keys = hot.count(), hot.select("_h1", "_h2")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    at = docs.select(*row_key(id_col, text_col), F.posexplode(lines).alias("_pos", "_line"))
    at = at.select(*KEY, "_pos", *_hashes(_line_key(F.col("_line"))))
    if n_hot <= BROADCAST_KEYS:
        at = at.join(F.broadcast(keys), ["_h1", "_h2"])
    else:  # the commonest lines are dealt to several tasks
        at = spread_join(at, keys, ["_h1", "_h2"], hot, hot.agg(F.sum("_n")).first()[0])
    gone = at.groupBy(*KEY).agg(F.array_sort(F.collect_set("_pos")).alias("_w_gone"))

    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", text_col)]
    rows = docs.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias("_w_text"), *row_key(id_col, text_col)).join(gone, KEY, "left")
    rows = rows.withColumn("_w_lines", F.split("_w_text", "\n", -1)).withColumn("_w_gone", F.coalesce("_w_gone", F.array().cast("array<int>")))
    n, m = F.size("_w_lines"), F.size("_w_gone")
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("_w_gone", i - 1))
    after = lambda i: F.when(i == m, n).otherwise(F.get("_w_gone", i))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), m), lambda i: F.slice("_w_lines", before(i) + 2, after(i) - before(i) - 1)))
    kept = F.when(m == 0, F.col("_w_text")).otherwise(F.array_join(kept, "\n"))
    out = rows.select(*own, kept.alias(text_col), n.cast("long").alias("n_lines"), m.cast("long").alias("n_dropped"))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")
