"""Column helpers shared by the operators: byte-exact case folding, row keys, checkpoints."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Separators of words made of ASCII letters, digits and anything beyond ASCII (after folding A-Z).
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space, as Python's bytes.split and bytes.strip take it.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; the whole-string fast path serves pure ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    """Words between NON_WORD separators; null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(c, F.lit(""))), NON_WORD), "")


def text_of(docs: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(docs[text_col], F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Names a row by its id and a fingerprint of its text, so that it survives recomputation.

    Rows alike in both get the same results, so they may share a key. Null ids
    and texts have keys too, since neither column of the key is ever null.
    """
    return [
        F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null"))).alias("_w_k1"),
        F.xxhash64(F.lit(7), F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null"))).alias("_w_k2"),
    ]


KEY = ["_w_k1", "_w_k2"]


def fold_of(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Takes the folder the cluster names; a temporary one of our own only where none is named and all runs on this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/weftline-{uuid.uuid4().hex}")


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and checkpoints of steps that are done: it does so once neither side of the driver holds them.

    A job of many steps would else pile them up on the executors' disks and in the driver until a collection comes by chance.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's rows an Arrow batch, since a row here is a whole text; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


#: A key with more rows than this, and than one in HOT_SHARE of all, is split in joins.
HOT_ROWS = 500
#: So many keys can be hot at most, which bounds what is broadcast to name them.
HOT_SHARE = 20_000


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """left join right on keys, where keys may be very frequent in left; right has few rows a key.

    counts has the keys and _n, their rows in left, and rows is the sum of them.
    A hot key's rows in left are dealt to parts of about as many rows as make a
    key hot, and its rows in right are repeated for each part; there are at most
    HOT_SHARE hot keys and rows / HOT_ROWS more rows on the right.
    """
    most = max(HOT_ROWS, -(-rows // HOT_SHARE))
    if rows <= most:
        return left.join(right, keys, how)
    hot = counts.where(F.col("_n") > most).select(*keys, F.ceil(F.col("_n") / most).cast("int").alias("_w_parts"))
    parts = F.coalesce("_w_parts", F.lit(1))
    others = [c for c in left.columns if c not in keys]
    left = left.join(F.broadcast(hot), keys, "left").withColumn("_w_part", F.pmod(F.xxhash64(*others), parts).cast("int")).drop("_w_parts")
    right = right.join(F.broadcast(hot), keys, "left").withColumn("_w_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_w_parts")
    return left.join(right, [*keys, "_w_part"], how).drop("_w_part")


def replace_columns(docs: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Adds columns; a column of docs with the same name gives way."""
    return docs.select(*[docs[c] for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])
