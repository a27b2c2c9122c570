"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Queries that fit the number of probes, at most; each is scanned for exactly, against every point.
SAMPLE = 256
#: On tables of up to so many times k points every query is compared with all of them.
SMALL = 16
#: Elements of one step's array of bucket costs.
ROOM = 8_000_000


@dataclass(frozen=True)
class CrossPolytope:
    """Tables of pseudo-rotations: three rounds of random signs and a fast Hadamard transform each.

    A table has `axes` rotations; a vector's bucket is the signed axis it is
    nearest to after each, so there are (2 * dimensions) ** axes buckets. A
    query probes `probes` buckets a table, the likeliest first.
    """

    tables: int = 4
    axes: int = 2
    probes: int = 800
    seed: int = 20

    def buckets_of(self, dim: int) -> int:
        return (2 << max(0, dim - 1).bit_length()) ** self.axes

    def _signs(self, dim: int) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        return rng.choice(np.array([-1.0, 1.0], np.float32), size=(self.tables, self.axes, 3, dim))

    def rotated(self, x: np.ndarray, table: int, axis: int) -> np.ndarray:
        """Pseudo-rotation of the rows of x, padded with zeros to a power of two."""
        dim = 1 << max(0, (x.shape[1] - 1)).bit_length()
        y = np.zeros((len(x), dim), np.float32)
        y[:, : x.shape[1]] = x
        signs = self._signs(dim)[table, axis]
        for k in range(3):
            y = y * signs[k]
            h = 1
            while h < dim:
                z = y.reshape(len(x), dim // (2 * h), 2, h)
                y = np.concatenate((z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]), axis=2).reshape(len(x), dim)
                h *= 2
            y /= np.float32(np.sqrt(dim))
        return y

    def costs(self, x: np.ndarray, table: int, axis: int) -> np.ndarray:
        """By signed axis, the squared distance by which the row's projection falls short of its largest one."""
        y = self.rotated(x, table, axis)
        both = np.concatenate((y, -y), axis=1)
        return (both.max(axis=1, keepdims=True) - both) ** 2

    def buckets(self, x: np.ndarray, table: int, probes: int = 1) -> np.ndarray:
        """The probes likeliest buckets of each row, in no order: those with the least sum of costs."""
        keys, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
        for axis in range(self.axes):
            more = self.costs(x, table, axis)
            n = more.shape[1]
            if probes == 1:
                keys = keys * n + np.argmin(more, axis=1)[:, None]
                continue
            # a bucket among the likeliest has a likeliest beginning, so nothing is lost by cutting after each axis
            keys = (keys[:, :, None] * n + np.arange(n)[None, None, :]).reshape(len(x), -1)
            cost = (cost[:, :, None] + more[:, None, :]).reshape(len(x), -1)
            if keys.shape[1] > probes:
                best = np.argpartition(cost, probes - 1, axis=1)[:, :probes]
                keys, cost = np.take_along_axis(keys, best, 1), np.take_along_axis(cost, best, 1)
        return keys

    def places(self, queries: np.ndarray, points: np.ndarray, who: np.ndarray) -> np.ndarray:
        """How many buckets a table the query of each point must probe, at least, to meet it in some table."""
        least = np.full(len(points), self.buckets_of(queries.shape[1]), np.int64)
        for table in range(self.tables):
            costs = [self.costs(queries, table, axis).astype(np.float64) for axis in range(self.axes)]
            own = sum(c[who, np.argmin(self.costs(points, table, axis), axis=1)] for axis, c in enumerate(costs))
            for i in range(len(queries)):
                mine, begin = np.flatnonzero(who == i), np.zeros(1)
                for c in costs[:-1]:
                    begin = (begin[:, None] + c[i][None, :]).ravel()
                below = np.searchsorted(np.sort(costs[-1][i]), own[mine][:, None] * (1 + 1e-9) + 1e-12 - begin[None, :], "right").sum(axis=1)
                least[mine] = np.minimum(least[mine], np.maximum(below, 1))
        return least


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of huge or tiny components would overflow or vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vectors: DataFrame, vec_col: str) -> DataFrame:
    """Without vectors that are null, zero or hold null or non-finite components."""
    v = F.col(vec_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~F.exists(v, bad)).where(F.exists(v, lambda x: x != 0))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from the first component on: the same for equal vectors."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * c[:, d]
    return total


def _best(owner: np.ndarray, ids: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the keep best rows of each owner, owner by owner: by score, then the smaller id."""
    order = np.lexsort((ids, -score, owner))
    owner = owner[order]
    start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, int)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.append(start, len(owner))))
    return order[rank < keep]


def _rows(owner: np.ndarray, ids: np.ndarray, points: np.ndarray, score: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """The columns of NEAR; rows of an owner stand together, ids and n are by owner."""
    cuts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True]))) if len(owner) else np.zeros(1, int)
    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(-score), pa.array(points)], ["s", "r"]))
    return [pa.array(ids[owner[cuts[:-1]]]), lists, pa.array(n[owner[cuts[:-1]]])]


def _top(qx: np.ndarray, px: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) places of at least the keep best points of each query, rounding and ties included."""
    if len(px) <= keep:
        return np.divmod(np.arange(len(qx) * len(px)), len(px))
    rough = qx @ px.T
    least = np.partition(rough, len(px) - keep, axis=1)[:, len(px) - keep]
    scale = np.linalg.norm(qx, axis=1) * np.linalg.norm(px, axis=1).max() * 1e-12
    return np.nonzero(rough >= (least - scale)[:, None])


#: A row a task and query: its best points as (minus the score, id), and with how many points it was compared.
NEAR = "query_id long, _best array<struct<s:double,r:long>>, _n long"


def _meet(points: DataFrame, queries: DataFrame, block: int, keep: int) -> DataFrame:
    """(query_id, rep, score): the keep best of the points that share a bucket with a query, of each task that both meet in.

    Both sides have (_table, _group, _buckets, _id, _v). A group is dealt into
    blocks of about block points and queries, which meet two by two, so a group
    with a third of all rows is spread. Inside, points and queries meet by bucket.
    """
    parts = lambda df, n: df.groupBy("_table", "_group").agg(F.ceil(F.count("*") / (2 * block)).cast("int").alias(n))
    sizes = cut(parts(points, "_pn").join(parts(queries, "_qn"), ["_table", "_group"]))
    # A point goes to its block and each block of queries, and the other way round.
    pick = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = points.join(sizes, ["_table", "_group"]).withColumn("_pb", pick("_pn")).withColumn("_qb", every_of("_qn")).withColumn("_query", F.lit(False))
    q = queries.join(sizes, ["_table", "_group"]).withColumn("_qb", pick("_qn")).withColumn("_pb", every_of("_pn")).withColumn("_query", F.lit(True))
    columns = ["_table", "_group", "_pb", "_qb", "_query", "_id", "_v", "_buckets"]

    def rerank(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        is_query = t.column("_query").to_numpy(zero_copy_only=False).astype(bool)
        ids, x, lists = t.column("_id").to_numpy(), _matrix(t.column("_v").combine_chunks()).astype(np.float64), t.column("_buckets").combine_chunks()
        owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        bucket = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.lexsort((~is_query[owner], bucket))  # by bucket, queries first
        owner, bucket = owner[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, int)
        n_queries = np.add.reduceat(is_query[owner].astype(np.int64), cuts[:-1]) if len(bucket) else np.zeros(0, int)
        seen, floor = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
        # what rounding can take from a product, so that the sums below lose no tie
        slack = np.linalg.norm(x, axis=1) * (np.linalg.norm(x[~is_query], axis=1).max() if (~is_query).any() else 0.0) * 1e-12
        found, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

        def pruned(found: list[tuple], exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, value = (np.concatenate(c) for c in zip(*found, strict=True))  # a pair meets in one bucket of a task at most
            if exact:
                value = _exact(x[a], x[b])
                best = _best(a, ids[b], value, keep)
                return a[best], b[best], value[best]
            best = _best(a, b, value, keep)
            last = np.flatnonzero(np.bincount(a[best], minlength=len(ids)) == keep)
            lowest = np.full(len(ids), np.inf)
            np.minimum.at(lowest, a[best], value[best])
            floor[last] = np.maximum(floor[last], (lowest - slack)[last])
            on = value >= floor[a]
            return a[on], b[on], value[on]

        for lo, hi, n in zip(cuts[:-1], cuts[1:], n_queries, strict=True):
            if 0 < n < hi - lo:
                mine, theirs = owner[lo : lo + n], owner[lo + n : hi]
                seen[mine] += len(theirs)
                px = x[theirs].T
                for s in range(0, n, max(1, ROOM // len(theirs))):
                    part = mine[s : s + max(1, ROOM // len(theirs))]
                    rough = x[part] @ px
                    if len(theirs) > 4 * keep:
                        least = np.partition(rough, len(theirs) - keep, axis=1)[:, len(theirs) - keep] - slack[part]
                        floor[part] = np.maximum(floor[part], least)
                    a, b = np.nonzero(rough >= floor[part][:, None])
                    found.append((part[a], theirs[b], rough[a, b]))
                    held += len(a)
                    if held > 300_000:
                        found = [pruned(found, False)]
                        if len(found[0][0]) > 150_000:  # very many ties, or very many queries
                            found = [pruned(found, True)]
                        held = max(0, len(found[0][0]) - 150_000)
        a, b, value = pruned(found, True)
        return pa.table(_rows(a, ids, ids[b], value, seen), names=["query_id", "_best", "_n"])

    met = p.select(columns).unionByName(q.select(columns))
    return met.groupBy("_table", "_group", "_pb", "_qb").applyInArrow(rerank, NEAR)


def _scanned(points: DataFrame, ids: np.ndarray, x: np.ndarray, keep: int) -> DataFrame:
    """(query_id, rep, score): every point against a bounded set of queries, the keep best a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(ids):
                reps, px = batch.column(0).to_numpy(), _matrix(batch.column(1)).astype(np.float64)
                a, b = _top(x, px, keep)
                score = _exact(x[a], px[b])
                best = _best(a, reps[b], score, keep)
                yield pa.RecordBatch.from_arrays(_rows(a[best], ids, reps[b[best]], score[best], np.full(len(ids), len(reps))), names=["query_id", "_best", "_n"])

    return points.select("_rep", "_v").mapInArrow(run, NEAR)


def _ranked(near: DataFrame, keep: int) -> DataFrame:
    """(query_id, rep, score, n): the keep best distinct points of each query, and all points it was compared with, once a table."""
    near = near.groupBy("query_id").agg(F.flatten(F.collect_list("_best")).alias("_best"), F.sum("_n").alias("_n"))
    near = near.select("query_id", "_n", F.inline(F.slice(F.array_sort(F.array_distinct("_best")), 1, keep)))
    return near.select("query_id", F.col("r").alias("_rep"), (F.lit(0.0) - F.col("s")).alias("score"), "_n")


def fitted(index: CrossPolytope, points: DataFrame, queries: DataFrame, k: int, recall: float) -> CrossPolytope:
    """The index with the fewest probes that find the given share of the k nearest points of a sample of queries.

    The sample is SAMPLE queries at most, in the order of a hash of their ids;
    their true neighbours come from a scan of all points. What the driver holds
    is the sample's k neighbours.
    """
    sample = queries.orderBy(F.xxhash64("_id"), "_id", "_h1").limit(SAMPLE).select("_id", "_v").toArrow().combine_chunks()
    if not len(sample):
        return index
    # Numbered, since an id may stand for several queries.
    x = _matrix(sample.column("_v").combine_chunks()).astype(np.float64)
    near = _ranked(_scanned(points, np.arange(len(x)), x, k + 1), k + 1).join(points.select("_rep", "_v"), "_rep").select("query_id", "_v").toArrow().combine_chunks()
    who, theirs = near.column("query_id").to_numpy(), _unit(_matrix(near.column("_v").combine_chunks()))
    need = np.sort(index.places(_unit(x), theirs, who))
    return replace(index, probes=int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]))


def search(vectors: DataFrame, index: CrossPolytope | None = None, k: int = 20, every: int = 20, block: int = 8192, recall: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", costs: bool = False) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by every, its k nearest by inner product.

    Without an index of the caller's, tables get an axis more whenever a bucket
    would hold over block points on average, and probes are fitted to a sample
    (see fitted()) to find the given share of its true neighbours. A query that
    got fewer than k asks again with four times the probes, until it has k or
    its probes are all buckets there are; then it is compared with every point,
    as all queries are on a table of SMALL * k points or fewer. With costs, met
    is how many points a query was compared with, once a table.

    Vectors that are null, zero or hold null or non-finite components, and rows
    with a null id, take no part; vectors of one table have one length, that of
    most rows (others take no part). Equal vectors are one point with its k + 1
    smallest ids, so a vector that many rows share is compared once. Buckets are
    dealt in ranges to groups of about 2 * block points, each vector once a
    table and group, and only the k + 1 best of a task go on. Ties go to the
    smaller id. An id that repeats with several vectors is a query with each of
    them, and never its own neighbour. Fewer than k candidates give fewer rows;
    an empty table gives none. Other columns are not read.
    """
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"
    rows = _usable(vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast(f"array<{kind}>").alias("_v")).where(F.col(id_col).isNotNull()), "_v")
    size = rows.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim = size["d"] if size else 1
    rows = rows.where(F.size("_v") == dim).select("_id", "_v", F.xxhash64("_v").alias("_h1"), F.xxhash64(F.lit(3), "_v").alias("_h2"))
    ids = rows.select("_h1", "_h2", "_id").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("_id"))).where(F.col("_r") <= k + 1)
    ids = ids.groupBy("_h1", "_h2").agg(F.min("_id").alias("_rep"), F.array_sort(F.collect_list("_id")).alias("_ids"))
    points = cut(rows.groupBy("_h1", "_h2").agg(F.first("_v").alias("_v")).join(ids, ["_h1", "_h2"]).select("_rep", "_ids", "_v"))
    queries = rows.where(F.pmod(F.col("_id"), F.lit(every)) == 0).groupBy("_id", "_h1", "_h2").agg(F.first("_v").alias("_v"))
    n_points = points.count()
    if index is None:
        index = CrossPolytope()
        while n_points > block * index.buckets_of(dim):
            index = replace(index, axes=index.axes + 1)
        index = fitted(index, points, queries, k, recall)
    n_buckets = index.buckets_of(dim)
    groups = min(n_buckets, max(1, -(-n_points // (2 * block))))

    def hashed(probes: int):
        step = max(1, ROOM // (2 * n_buckets if index.axes < 3 else 2 * probes * dim))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    own = batch.slice(lo, step)
                    x = _unit(_matrix(own.column(1)))
                    for table in range(index.tables):
                        keys = np.sort(index.buckets(x, table, probes), axis=1)
                        n = keys.shape[1]
                        group = keys * groups // n_buckets
                        fresh = np.ones(keys.shape, bool)
                        fresh[:, 1:] = group[:, 1:] != group[:, :-1]
                        at = np.flatnonzero(fresh.ravel())
                        lists = pa.ListArray.from_arrays(pa.array(np.append(at, keys.size), pa.int32()), pa.array(keys.ravel()))
                        rep = pa.array(at // n)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), table, np.int32)), pa.array(group.ravel()[at]), lists, own.column(0).take(rep), own.column(1).take(rep)], names=["_table", "_group", "_buckets", "_id", "_v"])

        return run

    schema = f"_table int, _group long, _buckets array<{'int' if n_buckets < 2**31 else 'long'}>, _id long, _v array<{kind}>"
    narrow = lambda run: (lambda batches: (b.cast(pa.schema([("_table", pa.int32()), ("_group", pa.int64()), ("_buckets", pa.list_(pa.int32() if n_buckets < 2**31 else pa.int64())), ("_id", pa.int64()), ("_v", b.schema.field("_v").type)])) for b in run(batches)))
    p = points.select(F.col("_rep").alias("_id"), "_v").mapInArrow(narrow(hashed(1)), schema)

    def told(near: DataFrame) -> DataFrame:
        """The k nearest ids of each query, from its k + 1 nearest points."""
        near = near.join(points.select("_rep", "_ids"), "_rep").select("query_id", "score", "_n", F.explode("_ids").alias("_id")).where(F.col("_id") != F.col("query_id"))
        near = near.groupBy("query_id", "_id").agg(F.max("score").alias("score"), F.max("_n").alias("_n"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "_id")
        return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def probed(asked: DataFrame, probes: int) -> DataFrame:
        q = asked.select("_id", "_v").mapInArrow(narrow(hashed(min(probes, n_buckets))), schema)
        return told(_ranked(_meet(p, q, block, k + 1), k + 1))

    def scanned(asked: DataFrame) -> DataFrame:
        place = lambda group: (F.lit(0).alias("_table"), group.alias("_group"), F.array(F.lit(0)).alias("_buckets"), "_id", "_v")
        deal: Column = F.pmod(F.xxhash64("_id"), F.lit(groups))
        every_point = points.select(F.col("_rep").alias("_id"), "_v").select(*place(deal))
        q = asked.select(*place(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))))
        return told(_ranked(_meet(every_point, q, block, k + 1), k + 1))

    if n_points <= SMALL * k:
        near = scanned(queries)
    else:
        probes = index.probes
        near = cut(probed(queries, probes))
        while True:
            counts = near.groupBy("query_id").agg(F.count("*").alias("_k"))
            short = queries.join(counts, queries["_id"] == counts["query_id"], "left").where(F.coalesce("_k", F.lit(0)) < k)
            short = cut(short.select("_id", "_v"))
            if short.isEmpty():
                break
            probes *= 4
            more = probed(short, probes) if probes < n_buckets else scanned(short)
            near = cut(near.join(short.select(F.col("_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more))
            if probes >= n_buckets:
                break
    met = [F.col("_n").alias("met")] if costs else []
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score", *met)
