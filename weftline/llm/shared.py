"""Files of arrays in the shared folder: tasks write them, workers map them, nothing passes through the driver."""

from __future__ import annotations

import mmap
import os
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession

from .common import ensure_checkpoint_dir
from .eliasfano import flatten, unflatten


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the checkpoint folder; the first file makes it."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _place(uri: str) -> tuple[fs.FileSystem | None, str]:
    """Without a file system where the folder is mounted; other stores are those that pyarrow opens (hdfs, s3, gs)."""
    mounted = re.match(r"(?:file:)?/+(.*)", uri)
    if mounted:
        return None, "/" + mounted[1]
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def write_arrays(uri: str, arrays: list[np.ndarray]) -> int:
    """Writes a file whole or not at all, so that a task may run twice; gives its bytes."""
    store, path = _place(uri)
    data = flatten(arrays)
    if store is None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            f.write(data)
        os.replace(own, path)
    else:
        store.create_dir(os.path.dirname(path))
        with store.open_output_stream(path) as f:  # the name appears when the stream is closed
            f.write(data)
    return len(data)


def map_arrays(uri: str) -> list[np.ndarray]:
    """Views of a file's arrays, memory-mapped where the folder is mounted, else over a copy without a name."""
    store, path = _place(uri)
    with open(path, "rb") if store is None else tempfile.TemporaryFile() as f:
        if store is not None:
            with store.open_input_stream(path) as source:
                shutil.copyfileobj(source, f, 1 << 20)
            f.flush()
        return unflatten(np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8))
