"""An index that follows a stream of messages: each batch is tokenised and its postings appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.search import lengths, postings

MAX_CONTENT = 100_000


def storable(messages: DataFrame, session: str = "session_id", text: str = "text") -> DataFrame:
    """Messages with a session and a text, cut to what the store keeps."""
    return messages.where(F.col(session).isNotNull() & (F.coalesce(F.col(text), F.lit("")) != "")).withColumn(text, F.substring(text, 1, MAX_CONTENT))


def append_to_index(batch: DataFrame, path: str, epoch: int, key: str = "id", text: str = "text") -> None:
    """Writes one batch's postings and sizes under its epoch, so that a repeated batch replaces itself."""
    posted = postings(batch, key, text)
    posted.write.mode("overwrite").parquet(f"{path}/postings/epoch={epoch}")
    lengths(batch, posted, key).write.mode("overwrite").parquet(f"{path}/sizes/epoch={epoch}")


def follow(messages: DataFrame, path: str, checkpoint: str, key: str = "id", text: str = "text", session: str = "session_id") -> StreamingQuery:
    """Starts indexing a stream of messages; takes what is there and stops."""
    write = lambda batch, epoch: append_to_index(storable(batch, session, text), path, epoch, key, text)
    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
