"""A corpus cleaned in stages: language, repeated lines, near copies, benchmark leaks, packing.

Each stage is written as Parquet to the shared folder and read again by the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, langid, linededup, neardup, packing
from weftline.llm.common import ensure_checkpoint_dir
from weftline.llm.queries import read, tokenizer_path

#: A document goes if its words are in no learned language (und), or if the best language has less than this share.
MIN_LANGUAGE_SHARE = 0.4


def _apart(docs: DataFrame, needs: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies an operator that keeps rows or changes texts, and returns the columns of docs as they were.

    The operator sees other columns under names that nothing it adds can clash
    with; what it adds is left out.
    """
    others = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in needs}
    out = operator(docs.withColumnsRenamed(others))
    return out.select(*[out[others.get(c, c)].alias(c) for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose words are mostly in one learned language.

    Null, empty and blank texts and those without a letter are und and go. If no
    row has a language, nothing can be learned and all rows go. Rows are judged
    by their text alone: repeated rows stay or go together, very long texts are
    read whole, a label that ties with another takes the first in order. All
    columns stay as they are, whatever their names; an empty table stays empty.
    """
    model = langid.train(docs)
    in_one = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SHARE)
    return _apart(docs, ("doc_id", "text"), lambda d: langid.identify(d, model).where(in_one))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten documents or more share; documents keep their other lines.

    Every row stays. Null text becomes the empty text, as does a text all of
    whose lines go. A repeated row counts as often as it stands. All other
    columns stay as they are, whatever their names; an empty table stays empty.
    """
    return _apart(docs, ("doc_id", "text"), linededup.dedup_lines)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8.

    The smallest id of a group stays, with every row that has it. Null, empty
    and blank texts link with nothing and stay, as do rows with a null id. All
    columns stay as they are, whatever their names; an empty table stays empty.
    """
    return _apart(docs, ("doc_id", "text"), lambda d: neardup.keep_one(d, neardup.near_duplicates(d)))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item, or all words of a shorter one.

    Null and wordless texts hold none and stay; repeated rows stay or go
    together. All columns stay as they are, whatever their names; empty tables
    on either side drop nothing.
    """
    return _apart(docs, ("doc_id", "text"), lambda d: decontaminate.remove_documents(decontaminate.scan(d, read(spark, sf_dir, "benchmark"))))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; one row a piece.

    Null text is empty and has the end token alone; rows without an id and
    repeated rows are packed like others. The columns are those of packing,
    whatever docs has; an empty table gives none.
    """
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", leak_stage),
    ("packing", pack_stage),
]

#: Language, near-duplicate sketches and packing have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
