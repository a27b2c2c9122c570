"""Files and JSON stores as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import store
from weftline.sources.places import entries, get, put

#: Folders that a scan never enters.
SKIPPED = [".git", ".svn", ".hg", "node_modules", "vendor", ".venv", "venv", "__pycache__", ".opencode", ".terraform", "dist", "build", ".next", ".nuxt", ".cache", ".ruff_cache"]
MAX_FILE, MAX_PROJECT_FILE = 500 * 1024, 3_000_000

TASK = """id string, type string, status string, prompt string, agent string, interval_secs int, last_run string, next_run string, created_at string,
completed_at string, result string, evaluation string, retries int, max_retries int, tags array<string>, evaluation_criteria string, reviewer_agent string,
review_prompt string, review_result string, review_evaluation string"""


def in_skipped_folder(path: Column) -> Column:
    """Whether a relative path runs through a folder that is skipped or hidden; hidden files are fine."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda d: d.isin(SKIPPED) | (d.startswith(".") & (d != ".")))


def is_skipped(name: str) -> bool:
    """in_skipped_folder() for the name of one folder."""
    return name in SKIPPED or (name.startswith(".") and name != ".")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length) of the files below root that no skipped or hidden folder holds.

    Spark's own listing leaves out names that begin with a dot or an underscore,
    `__init__.py` among them, so tasks list the folders themselves, level by
    level; the driver holds the names of the folders. The root is a folder that
    driver and executors have mounted, or lies in a store that pyarrow opens.
    """
    root = root.rstrip("/")
    cores = spark.sparkContext.defaultParallelism

    def each(what: Callable[[str], Iterator[tuple]], names: list[str]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    rows = list(what(folder))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(len(names))], names=names)

        return run

    inside = lambda folder, name: f"{folder}/{name}" if folder else name
    folders_in = lambda folder: ((inside(folder, d),) for d in entries(f"{root}/{folder}")[1] if not is_skipped(d))
    files_in = lambda folder: ((inside(folder, n), t, size) for n, t, size in entries(f"{root}/{folder}")[0])
    found, level = [""], [""]
    while level:
        dealt = spark.createDataFrame([(x,) for x in level], "folder string").repartition(min(cores, len(level)))
        level = [r[0] for r in dealt.mapInArrow(each(folders_in, ["folder"]), "folder string").collect()]
        found += level
    dealt = spark.createDataFrame([(x,) for x in found], "folder string").repartition(min(4 * cores, len(found)))
    return dealt.mapInArrow(each(files_in, ["path", "mtime", "length"]), "path string, mtime long, length long")


def with_content(files: DataFrame, root: str) -> DataFrame:
    """Adds content to (path, mtime, length) of files below root, each read by the task that has its row; a file that has gone since is left out."""
    root = root.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 32):
                part, data = batch.slice(lo, 32), []
                for path in part.column(0).to_pylist():
                    try:
                        data.append(get(f"{root}/{path}"))
                    except FileNotFoundError:
                        data.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=["path", "mtime", "length", "content"])

    return files.select("path", "mtime", "length").mapInArrow(run, "path string, mtime long, length long, content binary").where(F.col("content").isNotNull())


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_FILE) -> DataFrame:
    """(path, mtime, length, content) of the files below root, without empty, large and skipped ones; sizes are filtered before bytes are read."""
    return with_content(sized(listed(spark, root), max_bytes), root)


def sized(files: DataFrame, max_bytes: int = MAX_FILE) -> DataFrame:
    return files.where((F.col("length") > 0) & (F.col("length") <= max_bytes))


def project_files(files: DataFrame, ignored: DataFrame) -> DataFrame:
    """(path, length) without .git, large and ignored files, in order."""
    rows = files.where((F.col("length") <= MAX_PROJECT_FILE) & ~F.col("path").rlike(r"(^|/)\.git/")).select("path", "length")
    return rows.join(ignored.select("path"), "path", "left_anti").orderBy("path")


def text_of(content: Column) -> Column:
    """Bytes as UTF-8 text; what isn't becomes the replacement character."""
    return F.make_valid_utf8(content.cast("string"))


def _documents(spark: SparkSession, *paths: str) -> DataFrame:
    fields = ", ".join(f.strip().replace(" ", ":", 1) for f in TASK.replace(chr(10), " ").split(", "))
    return spark.read.schema(f"tasks array<struct<{fields}>>, parts string").option("multiLine", True).option("mode", "PERMISSIVE").json(list(paths))


def _parts(documents: DataFrame) -> list[str]:
    return [r[0] for r in documents.select("parts").where(F.col("parts").isNotNull()).collect()]


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of {"tasks": [...]} files, and of the documents in the folder that one names as its parts; a corrupt file gives none."""
    raw = _documents(spark, path)
    if parts := _parts(raw):
        raw = raw.unionByName(_documents(spark, *[f"{path}/{x}" for x in parts]))
    return raw.where(F.col("tasks").isNotNull()).select(F.inline("tasks"))


def write_tasks(tasks: DataFrame, path: str, most: int = 10_000) -> None:
    """One {"tasks": [...]} document in the folder, in place of the one before, which a reader sees until this one is whole.

    It is the form that a scheduler's table is handed over in. Of a table of more
    than `most` tasks the document names a hidden folder of parts, documents of
    at most so many, so that no row, task or file holds all of it. Older parts go,
    but for those just replaced, which may still be read. Tables that several
    write to are kept in a store, see store.merge().
    """
    spark = tasks.sparkSession
    own = f".parts/{uuid.uuid4().hex}" if tasks.limit(most + 1).count() > most else None
    fs, parent = store._fs(spark, f"{path}/.parts")
    known = [s.getPath() for s in fs.listStatus(parent)] if fs.exists(parent) else []
    before = {x.rsplit("/", 1)[-1] for x in _parts(_documents(spark, f"{path}/tasks.json"))} if known else set()

    def write(name: Callable[[int], str]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for batch in batches:
                for lo in range(0, batch.num_rows, most):
                    put(f"{path}/{name(n)}", ('{"tasks":[' + ",".join(batch.column(0).slice(lo, most).to_pylist()) + "]" + closing + "}").encode())
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

        return run

    closing = ""
    rows = tasks.select(F.to_json(F.struct(*tasks.columns), {"ignoreNullFields": "false"}).alias("j"))
    if own:
        # A task that runs twice writes the same names.
        rows.mapInArrow(write(lambda n: f"{own}/{TaskContext.get().partitionId()}-{n}.json"), "n long").agg(F.sum("n")).collect()
        rows, closing = spark.createDataFrame([("",)], "j string"), f',"parts":"{own}"'
    else:
        rows = rows.agg(F.array_join(F.collect_list("j"), ",").alias("j"))
    rows.mapInArrow(write(lambda _: "tasks.json"), "n long").collect()
    for old in known:
        if old.getName() not in before:
            fs.delete(old, True)


def write_texts(texts: DataFrame, folder: str, path: str = "path", text: str = "text") -> int:
    """Writes each text whole to its path below folder, in place of what was there; gives how many. Null texts are left out.

    Tasks write the files, each under a name of its own first, so that a task may
    run twice and a reader sees a file whole. Two texts of one path are refused,
    and so is a path that is empty or leaves the folder. The folder is one that
    driver and executors have mounted, or a store that pyarrow opens.
    """
    rows = texts.select(F.col(path).alias("p"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    bad = F.col("p").isNull() | F.col("p").rlike(r"^/|^$|(^|/)\.\.(/|$)|/$")
    if rows.where(bad).limit(1).count() or rows.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") > 1).limit(1).count():
        raise ValueError("a path is empty, leaves the folder, or stands more than once")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                put(f"{folder}/{p}", t.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of all files below folder that no skipped or hidden folder holds."""
    return with_content(listed(spark, folder), folder).select("path", text_of(F.col("content")).alias("text"))


def append_log(lines: DataFrame, folder: str, line: str = "line") -> None:
    """Adds lines to a session's log."""
    lines.select(F.col(line).alias("value")).write.mode("append").text(folder)


def export_session(messages: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(by, markdown): each session as one text with a heading a message; for sessions that fit a row."""
    block = F.concat(F.lit("## "), F.col(role), F.lit("\n\n"), F.coalesce(F.col(text), F.lit("")))
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b"))))
    return messages.groupBy(by).agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("markdown"))


def save_presets(presets: DataFrame, folder: str, key: str = "name") -> int:
    """Saves presets over those of the same name, as one new version of the store; gives its number."""
    return store.merge(presets.sparkSession, folder, presets, key)


def delete_presets(names: DataFrame, folder: str, key: str = "name") -> int:
    spark = names.sparkSession
    return store.merge(spark, folder, store.read(spark, folder).limit(0), key, gone=names)


def read_presets(spark: SparkSession, folder: str) -> DataFrame:
    """The presets that were saved last and not deleted since; of two that saved at once the one with the later version."""
    return store.read(spark, folder)


def tail(lines: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The last n lines, in order."""
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def fresh(catalog: DataFrame, now: Column, fetched: str = "fetched_at", seconds: int = 3600) -> DataFrame:
    """Rows fetched less than `seconds` ago."""
    return catalog.where(F.unix_seconds(now) - F.unix_seconds(F.col(fetched).cast("timestamp")) < seconds)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing values, and missing columns, take their defaults."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})
