"""Near-duplicate groups: SetSketch registers, banded, estimated jointly by likelihood, verified on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, release, spread_join
from .shared import new_folder, remove_folder
from .tokens import chunks, hashed_words, mix, shingles

_U = np.uint64


@dataclass(frozen=True)
class Sketch:
    """Registers K_j = floor(1 - log_base(min of Exp(rate) over the set)), cut to two bytes, in bands x rows.

    At a similarity of 0.8 a pair misses all 32 bands of 5 with probability 3e-6.
    With so small a base, unrelated sets of like size agree in a register with
    probability 5e-4 and in a band with 3e-17, so buckets hold no strangers at any
    number of rows.
    """

    bands: int = 32
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0

    @property
    def registers(self) -> int:
        return self.bands * self.rows

    def of(self, sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Registers of each set; an empty set has zeros. Merging two sets' sketches is their maximum."""
        out = np.zeros((len(offsets) - 1, self.registers), np.uint16)
        full = np.flatnonzero(np.diff(offsets) > 0)
        at, factors = offsets[:-1][full], mix(np.arange(1, self.registers + 1, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)
        if not len(full):
            return out
        least = np.empty((self.registers, len(full)), _U)
        for j, a in enumerate(factors):
            x = sets * a
            x ^= x >> _U(29)
            least[j] = np.minimum.reduceat(x * _U(0xBF58476D1CE4E5B9), at)
        u = (least.astype(np.float64) + 1.0) / 2.0**64
        exp = -np.log1p(-np.minimum(u, 1 - 1e-16)) / self.rate
        out[full] = np.clip(np.floor(1 - np.log(exp) / math.log(self.base)), 0, 65_535).T.astype(np.uint16)
        return out

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """A 64-bit key of each band; the band is part of it."""
        grouped = registers.reshape(len(registers), self.bands, self.rows).astype(_U)
        key = mix(np.arange(self.bands, dtype=_U) + _U(77))[None, :]
        for r in range(self.rows):
            key = mix(key * _U(0x9E3779B97F4A7C15) + grouped[:, :, r] + _U(1))
        return key.view(np.int64)

    def jaccard(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Maximum-likelihood similarity of pairs of sketches whose set sizes are known, on a grid of 1/64.

        With shares u and v of the sizes and p(x) = -log_base(1 - x (base - 1) / base), a register of a is larger
        with probability p(u - v J), smaller with p(v - u J), else equal.
        """
        more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
        same = self.registers - more - less
        u = na / np.maximum(na + nb, 1)
        v = 1 - u
        top = np.minimum(u, v) / np.maximum(np.maximum(u, v), 1e-12)
        p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (self.base - 1) / self.base) / math.log(self.base)
        best, out = np.full(len(u), -np.inf), np.zeros(len(u))
        for k in range(65):
            j = top * k / 64
            x, y = p(u - v * j), p(v - u * j)
            score = more * np.log(np.maximum(x, 1e-12)) + less * np.log(np.maximum(y, 1e-12)) + same * np.log(np.maximum(1 - x - y, 1e-12))
            better = score > best
            best, out = np.where(better, score, best), np.where(better, j, out)
        return out


def _fingerprints(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each set: equal sets, and in practice only those, share both."""
    out = np.zeros((len(offsets) - 1, 2), _U)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        for k in range(2):
            out[full, k] = np.add.reduceat(mix(sets + _U(0x5851F42D4C957F2D * (k + 1) % 2**64)), offsets[:-1][full])
    return mix(out + np.diff(offsets).astype(_U)[:, None]).view(np.int64)


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary a row from a flat array; offsets count values."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def sketches(docs: DataFrame, sketch: Sketch, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, f2, registers) of each row; ids must be integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in chunks(batch.column(1)):
                h, rows = hashed_words(data, offsets)
                sets, at = shingles(h, rows, hi - lo, width)
                prints, registers = _fingerprints(sets, at), sketch.of(sets, at)
                flat = _binary(registers.reshape(-1), np.arange(hi - lo + 1, dtype=np.int64) * sketch.registers)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), flat], names=["_id", "_n", "_f1", "_f2", "_regs"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "_id long, _n long, _f1 long, _f2 long, _regs binary")


def _band_keys(classes: DataFrame, sketch: Sketch) -> DataFrame:
    """(id, key), a row for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = sketch.keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, sketch.registers))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sketch.bands)), pa.array(keys.reshape(-1))], names=["_id", "_key"])

    return classes.select("_id", "_regs").mapInArrow(run, "_id long, _key long")


def _per(pairs: DataFrame) -> tuple[DataFrame, int]:
    """Pairs by their first, for spread_join, and all of them."""
    counts = cut(pairs.groupBy("_a").agg(F.count("*").alias("_n")))
    return counts, counts.agg(F.sum("_n")).first()[0] or 0


def _likely(pairs: DataFrame, classes: DataFrame, sketch: Sketch, at_least: float) -> DataFrame:
    """The distinct pairs (a, b) whose estimated similarity is at_least or more; a is a pivot and may have very many."""
    regs = classes.select("_id", "_n", "_regs")
    of = lambda side: regs.withColumnsRenamed({"_id": side, "_n": f"{side}n", "_regs": f"{side}r"})
    pairs = spread_join(pairs, of("_a"), ["_a"], *_per(pairs)).join(of("_b"), "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
                na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (4, 5))
                keep = np.flatnonzero(sketch.jaccard(a, b, na, nb) >= at_least)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["_a", "_b"])

    return pairs.select("_a", "_b", "_ar", "_br", "_an", "_bn").mapInArrow(run, "_a long, _b long")


def _sets(docs: DataFrame, wanted: DataFrame, rows: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of the rows with a wanted id: the ids are broadcast while they are few, else both sides are shuffled."""
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(wanted) if rows <= 2_000_000 else wanted, "_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                h, r = hashed_words(data, offsets)
                sets, at = shingles(h, r, hi - lo, width)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _binary(sets, at)], names=["_id", "_set"])

    # A repeated id would make its pairs repeat; one row of them is enough, since classes have picked the id.
    return own.mapInArrow(run, "_id long, _set binary")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B| on their full shingle sets."""
    wanted = cut(pairs.select(F.explode(F.array("_a", "_b")).alias("_id")).distinct())
    sets = cut(_sets(docs, wanted, wanted.count(), width, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            a_sets, b_sets = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                if _similar(np.frombuffer(a_sets[i].as_buffer(), _U), np.frombuffer(b_sets[i].as_buffer(), _U), percent):
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], names=["_a", "_b"])

    full = pairs.join(sets.withColumnsRenamed({"_id": "_b", "_set": "_bs"}), "_b")
    full = spread_join(full, sets.withColumnsRenamed({"_id": "_a", "_set": "_as"}), ["_a"], *_per(pairs))
    return full.select("_a", "_b", "_as", "_bs").mapInArrow(run, "_a long, _b long").distinct()


def connected_components(edges: DataFrame, a: str = "_a", b: str = "_b") -> DataFrame:
    """(id, component) of every id in edges; component is the smallest id reachable.

    Alternates the large-star and small-star steps until nothing changes; each
    star only needs a minimum a node, which is combined before the shuffle, and
    the edges of a node with very many are dealt to several tasks. Each round's
    edges are a table in the checkpoint folder, deleted two rounds later; a
    checkpoint would hand its size estimate on, which joins multiply until the
    number itself fills the driver.
    """
    spark, folder, step = edges.sparkSession, new_folder(edges.sparkSession, "components"), 0

    def written(df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{step}")
        return spark.read.schema("u long, v long").parquet(f"{folder}/{step}")

    edges = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    n, before = edges.count(), None
    while n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("_n"))
        large = spread_join(both, least.select("u", "m"), ["u"], least, 2 * n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = spread_join(large, least.select("u", "m"), ["u"], least, n)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where(F.col("u") != F.col("v"))
        step += 1
        edges = written(small.distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        if step > 1:
            remove_folder(spark, f"{folder}/{step - 2}")
        before, n = now, now["n"]
    return edges.select(F.col("u").alias("_id"), F.col("v").alias("_component")).unionByName(edges.select(F.col("v").alias("_id"), F.col("v").alias("_component")).distinct())


def _mates(t: pa.Table, sketch: Sketch, percent: int, at_least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a bucket's block, the rows it may link with in another component.

    A pair is left to the first band that both rows share, so no other bucket sees it again.
    """
    ids, comp, part, n = (t.column(c).to_numpy() for c in ("_id", "_component", "_part", "_n"))
    lo, hi, key = t.column("_lo")[0].as_py(), t.column("_hi")[0].as_py(), t.column("_key")[0].as_py()
    regs = np.frombuffer(b"".join(t.column("_regs").to_pylist()), np.uint16).reshape(len(ids), -1)
    keys = sketch.keys(regs)
    band = int(np.flatnonzero(keys[0] == key)[0])
    for i in range(len(ids)):
        mates = (comp > comp[i]) if lo == hi else ((comp != comp[i]) & (part[i] == lo) & (part == hi))
        mates = np.flatnonzero(mates & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        mates = mates[~(keys[mates, :band] == keys[i, :band]).any(axis=1)]
        if len(mates):
            sizes = n[mates].astype(float)
            near = sketch.jaccard(np.broadcast_to(regs[i], (len(mates), regs.shape[1])), regs[mates], np.full(len(mates), float(n[i])), sizes) >= at_least
            if near.any():
                yield i, mates[near]


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |A and B| >= percent * |A or B|, of sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)


def _open_links(members: DataFrame, classes: DataFrame, docs: DataFrame, sketch: Sketch, percent: int, at_least: float, width: int, id_col: str, text_col: str, block: int = 1024) -> DataFrame:
    """Verified links (a, b) across components inside the buckets that still hold several; enough to join what links join.

    A bucket of g members is dealt into ceil(g / block) parts, and each two parts
    meet in a task of their own, so no task holds more than two blocks. A first
    pass over sketches picks the members with a likely mate, a second verifies
    theirs on full sets; pairs are never written, and a pair whose rows have been
    joined meanwhile is skipped.
    """
    parts = members.withColumn("_parts", F.ceil(F.col("_g") / block).cast("int")).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    parts = parts.select("_key", "_id", "_component", "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    parts = parts.select("_key", "_id", "_component", "_part", F.least("_part", "_other").alias("_lo"), F.greatest("_part", "_other").alias("_hi"))
    full = classes.select("_id", "_n", "_regs")
    by = ["_key", "_lo", "_hi"]

    def pick(t: pa.Table) -> pa.Table:
        used: set[int] = set()
        for i, mates in _mates(t, sketch, percent, at_least):
            used.update([i, *mates.tolist()])
        return t.select([*by, "_id", "_component", "_part"]).take(pa.array(sorted(used), pa.int64()))

    def verify(t: pa.Table) -> pa.Table:
        ids, sets = t.column("_id").to_numpy(), [np.frombuffer(x.as_buffer(), _U) for x in t.column("_set")]
        root = {c: c for c in t.column("_component").to_pylist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        comp, out = t.column("_component").to_pylist(), []
        for i, mates in _mates(t, sketch, percent, at_least):
            for j in mates.tolist():
                if find(comp[i]) != find(comp[j]) and _similar(sets[i], sets[j], percent):
                    root[find(comp[i])] = find(comp[j])
                    out.append((ids[i], ids[j]))
        return pa.table({"_a": pa.array([a for a, _ in out], pa.int64()), "_b": pa.array([b for _, b in out], pa.int64())})

    # Dealt to a number of tasks of its own, since rows are small here and the work on them isn't.
    deal = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    picked = cut(deal(parts.join(full, "_id")).groupBy(*by).applyInArrow(pick, "_key long, _lo int, _hi int, _id long, _component long, _part int"))
    wanted = cut(picked.select("_id").distinct())
    sets = _sets(docs, wanted, wanted.count(), width, id_col, text_col)
    return deal(picked.join(full, "_id").join(sets, "_id")).groupBy(*by).applyInArrow(verify, "_a long, _b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, sketch: Sketch | None = None, margin: float = 0.15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of docs; integer ids.

    Words are split at ASCII white space with A-Z lower-cased; a row's set is its
    distinct shingles of width words, or all its words if fewer. Rows link with
    100 * intersection >= percent * union, and component_id is the smallest id
    that links reach. Null, empty and blank texts have no shingles and stand
    alone. Rows with a null id are answered, with a null component, and link
    with nothing. Rows that repeat an id are one document with several texts:
    their links meet. An empty table gives an empty table.

    Rows with equal sets are one class before anything is compared. Classes that
    share a band meet through the least id of their bucket; a pair goes on if
    the likelihood of its registers peaks within margin of the bound, and is
    verified on the full sets. Buckets that still hold several components then
    have all their likely pairs across components verified, a block of a bucket
    at a time, so what one pivot misses is not lost.
    """
    sketch = sketch or Sketch()
    bound_batches(docs.sparkSession)
    docs = docs.select(id_col, text_col)
    rows = cut(sketches(docs, sketch, width, id_col, text_col))
    valid = rows.where((F.col("_n") > 0) & F.col("_id").isNotNull())
    classes = valid.groupBy("_f1", "_f2").agg(F.min("_id").alias("_id"), F.first("_n").alias("_n"), F.first("_regs").alias("_regs"))
    classes = cut(classes)
    keys = cut(_band_keys(classes, sketch))
    buckets = cut(keys.groupBy("_key").agg(F.min("_id").alias("_pivot"), F.count("*").alias("_n")).where(F.col("_n") > 1))
    shared = cut(spread_join(keys, buckets.withColumnRenamed("_n", "_g"), ["_key"], buckets, buckets.agg(F.sum("_n")).first()[0] or 0))
    pairs = shared.where(F.col("_id") != F.col("_pivot")).select(F.col("_pivot").alias("_a"), F.col("_id").alias("_b")).distinct()
    likely = cut(_likely(pairs, classes, sketch, percent / 100 - margin))
    release(docs.sparkSession)
    links = cut(_verified(likely, docs, percent, width, id_col, text_col))
    parts = connected_components(links)

    # What the pivots left open: buckets of three or more whose members are still in several components.
    members = cut(shared.where(F.col("_g") > 2).join(parts, "_id", "left").withColumn("_component", F.coalesce("_component", "_id")))
    mixed = members.groupBy("_key").agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi"), F.count("*").alias("_n")).where(F.col("_lo") != F.col("_hi"))
    mixed = cut(mixed.select("_key", "_n"))
    members = spread_join(members, mixed.select("_key"), ["_key"], mixed, mixed.agg(F.sum("_n")).first()[0] or 0)
    release(docs.sparkSession)
    more = _open_links(members, classes, docs, sketch, percent, percent / 100 - margin, width, id_col, text_col)
    # A repeated id joins the classes of its texts.
    same = valid.select("_id", "_f1", "_f2").distinct().join(classes.select("_f1", "_f2", F.col("_id").alias("_rep")), ["_f1", "_f2"])
    same = cut(same.select("_id", "_rep"))
    repeats = same.groupBy("_id").agg(F.count("*").alias("_c"), F.min("_rep").alias("_m")).where(F.col("_c") > 1)
    repeats = same.join(repeats.select("_id", "_m"), "_id").select(F.col("_m").alias("_a"), F.col("_rep").alias("_b"))
    parts = connected_components(links.unionByName(more).unionByName(repeats))

    found = same.groupBy("_id").agg(F.min("_rep").alias("_rep")).join(parts.select(F.col("_id").alias("_rep"), "_component"), "_rep", "left")
    found = found.select("_id", F.coalesce("_component", "_rep").alias("_component"))
    out = rows.select(F.col("_id"), F.col("_n")).join(found, "_id", "left")
    component = F.coalesce("_component", "_id")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), (F.col("_id").isNull() | (F.col("_id") == component)).alias("kept"))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that near_duplicates() keeps: one id of each group, and every row without an id."""
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col("_gone"), "left_anti")
