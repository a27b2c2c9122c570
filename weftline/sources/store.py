"""Tables with versions: each commit is a snapshot that a small file names, and that file appears whole or not at all."""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Keys that a merge sends to every task; joins with more are dealt out, however small they look when compressed.
FEW_KEYS = 100_000


class Conflict(RuntimeError):
    """Another writer was faster, or has changed a row since it was read."""


def _fs(spark: SparkSession, path: str):
    """(file system, qualified path)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file whole under a name that is still free; False if the name is taken."""
    fs, target = _fs(spark, path)
    _, own = _fs(spark, re.sub(r"([^/]+)$", rf".\1.{uuid.uuid4().hex}", path))
    with contextlib.closing(fs.create(own, False)) as out:
        out.write(bytearray(text.encode()))
    if fs.getUri().getScheme() == "file":
        # A local rename replaces what is there; a link to the finished file doesn't.
        try:
            os.link(own.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(own, False)
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(own, target, none)
        return True
    except Exception as e:  # py4j has no class for it on this side
        fs.delete(own, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that can be read, oldest first."""
    fs, path = _fs(spark, f"{folder}/versions")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))


def _manifest(spark: SparkSession, folder: str, version: int | None) -> tuple[int, dict]:
    there = versions(spark, folder)
    if version is None and not there:
        return 0, {}
    version = there[-1] if version is None else version
    if version not in there:
        raise ValueError(f"there is no version {version}")
    fs, path = _fs(spark, f"{folder}/versions/{version:012d}.json")
    with contextlib.closing(fs.open(path)) as f:
        return version, json.loads(bytes(f.readAllBytes()).decode())


def notes(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """What the writer of a version left beside its data; nothing before the first."""
    return _manifest(spark, folder, version)[1].get("notes", {})


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version, by default the last one; what is written later doesn't change it."""
    version, found = _manifest(spark, folder, version)
    if not found:
        raise ValueError("nothing has been committed")
    return spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{folder}/{found['data']}")


def commit(spark: SparkSession, folder: str, rows: DataFrame, base: int, notes: dict | None = None) -> int:
    """Writes rows as the version after base and gives its number; Conflict if there is one already."""
    data = f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/{data}")
    fs, parent = _fs(spark, f"{folder}/versions")
    fs.mkdirs(parent)
    if not publish(spark, f"{folder}/versions/{base + 1:012d}.json", json.dumps({"data": data, "schema": json.loads(rows.schema.json()), "notes": notes or {}})):
        fs.delete(_fs(spark, f"{folder}/{data}")[1], True)
        raise Conflict(f"version {base + 1} has been written by another")
    return base + 1


def merge(spark: SparkSession, folder: str, changes: DataFrame, key: str = "id", gone: DataFrame | None = None, read_at: int | None = None, tries: int = 20) -> int:
    """Puts changes in place of rows with the same key, adds the others, takes out those of gone; gives the new version.

    A writer that loses the race merges into what the winner wrote, so no
    writer's rows are lost. With read_at, the version that the changes are based
    on, Conflict is raised if a row they touch has been changed, added or taken
    out since. A key may stand once in changes, and not in gone as well; a null
    key is refused. The first merge makes the store.
    """
    gone = (changes.select(key).limit(0) if gone is None else gone.select(key)).distinct()
    touched = changes.select(key).unionAll(gone).groupBy(key).agg(F.count("*").alias("_n"))
    many, bad = touched.agg(F.count("*"), F.count_if((F.col("_n") > 1) | F.col(key).isNull())).first()
    if bad:
        raise ValueError(f"a {key} is null or stands more than once")
    sized = F.broadcast if many <= FEW_KEYS else lambda rows: rows.hint("merge")
    gone, touched = sized(gone), sized(touched.select(key))
    for _ in range(tries):
        base, found = _manifest(spark, folder, None)
        if not found:
            merged = changes.join(gone, key, "left_anti")
        else:
            old = read(spark, folder, base)
            if read_at is not None and read_at != base:
                before = read(spark, folder, read_at).select(old.columns)
                if old.exceptAll(before).unionAll(before.exceptAll(old)).join(touched, key, "left_semi").limit(1).count():
                    raise Conflict(f"a row has been changed since version {read_at}")
            merged = old.join(touched, key, "left_anti").unionByName(changes, allowMissingColumns=True)
        try:
            return commit(spark, folder, merged, base)
        except Conflict:
            continue
    raise Conflict(f"{tries} other writers were faster")


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Deletes all but the last versions with their data, oldest first; gives how many went. Readers of those must be done."""
    fs, _ = _fs(spark, folder)
    old = versions(spark, folder)[:-keep]
    for v in old:
        _, found = _manifest(spark, folder, v)
        fs.delete(_fs(spark, f"{folder}/versions/{v:012d}.json")[1], False)
        fs.delete(_fs(spark, f"{folder}/{found['data']}")[1], True)
    return len(old)
