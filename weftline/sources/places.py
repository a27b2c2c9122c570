"""Single files that tasks read and write: on a mounted folder, or in a store that pyarrow opens."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of files that one task works on, where a row makes many.
SHARE = 16 << 20


def _place(path: str):
    """(None, a mounted path), or (store, a path in it)."""
    mounted = re.match(r"(?:file:)?/+(.*)", path)
    if mounted:
        return None, "/" + mounted[1]
    from pyarrow import fs  # starts threads, which workers are not to fork with

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def get(path: str) -> bytes:
    store, place = _place(path)
    if store is None:
        return Path(place).read_bytes()
    with store.open_input_stream(place) as f:
        return f.read()


def put(path: str, data: bytes) -> None:
    """Writes a file whole or not at all, in place of what was there."""
    store, place = _place(path)
    if store is None:
        target = Path(place)
        target.parent.mkdir(parents=True, exist_ok=True)
        own = target.with_name(f".{uuid.uuid4().hex}")
        own.write_bytes(data)
        os.replace(own, target)
    else:
        with store.open_output_stream(place) as f:  # the name appears when the stream is closed
            f.write(data)


def entries(folder: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """((name, time, bytes) of the files, names of the folders) in a folder; links to folders aren't followed."""
    store, place = _place(folder)
    if store is None:
        with os.scandir(place) as found:
            there = list(found)
        files = [(e.name, int(e.stat().st_mtime), e.stat().st_size) for e in there if e.is_file()]
        return files, [e.name for e in there if e.is_dir(follow_symlinks=False)]
    from pyarrow import fs

    there = store.get_file_info(fs.FileSelector(place))
    files = [(e.base_name, int(e.mtime.timestamp()) if e.mtime else 0, e.size) for e in there if e.type == fs.FileType.File]
    return files, [e.base_name for e in there if e.type == fs.FileType.Directory]


def dealt(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """Rows read from files, over all cores and no more than about `share` bytes a task; small enough pieces stay as they lie.

    What a task makes of its rows, their words or lines, is many times as large
    and is held in its memory, so tasks must not grow with the table.
    """
    spark, size = rows.sparkSession, 0
    for name in rows.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    n = max(spark.sparkContext.defaultParallelism, -(-size // share))
    return rows.repartition(n, F.xxhash64(*rows.columns)) if rows.rdd.getNumPartitions() < n else rows
