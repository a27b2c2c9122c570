"""Exact joins of n-gram sets at a high Jaccard similarity, by tries of sets in one global order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import bound_batches, release, spread_join
from .neardup import _binary, _fingerprints, connected_components
from .shared import new_folder, remove_folder
from .tokens import chunks, hashed_words, shingles

_U = np.uint64
#: One in so many n-grams, by hash, is counted to leave out texts that can't link.
SAMPLE = 4
#: Sets and n-grams that a trie holds at most, but for a single larger set.
BLOCK_SETS, BLOCK_GRAMS = 512, 100_000
#: So many ids are broadcast at most to find their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, n-gram hashes sorted in each row, offsets) of (id, text)."""
    for batch in batches:
        for lo, hi, data, offsets in chunks(batch.column(1)):
            h, r = hashed_words(data, offsets)
            yield batch.column(0).slice(lo, hi - lo), *shingles(h, r, hi - lo, width)


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """(id, n, f1, f2, sample) of (id, text): the set's size and fingerprints, and its n-grams in the sampled part of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, at in _sets(batches, width):
            prints, taken = _fingerprints(sets, at), sets < _U(2**64 // SAMPLE)
            upto = np.concatenate(([0], np.cumsum(taken)))[at]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), _binary(sets[taken], upto)], names=["_id", "_n", "_f1", "_f2", "_sample"])

    return docs.mapInArrow(run, "_id long, _n long, _f1 long, _f2 long, _sample binary")


def _exploded(rows: DataFrame) -> DataFrame:
    """(c, gram) of (c, binary of grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(v) // 8 for v in values])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.frombuffer(b"".join(values), np.int64))], names=["_c", "_gram"])

    return rows.mapInArrow(run, "_c long, _gram long")


def _whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """(f1, f2, set) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, at in _sets(batches, width):
            prints = _fingerprints(sets, at)
            yield pa.RecordBatch.from_arrays([pa.array(prints[:, 0]), pa.array(prints[:, 1]), _binary(sets, at)], names=["_f1", "_f2", "_set"])

    return docs.mapInArrow(run, "_f1 long, _f2 long, _set binary")


@dataclass
class Side:
    """Sets of a block as sorted places in the block's order, or their first grams; sizes of the whole sets; grams that aren't here."""

    grams: list[np.ndarray]
    sizes: np.ndarray
    tails: np.ndarray


def shared_overlaps(probes: Side, stored: Side, n_grams: int, percent: int, owner: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(place of a stored set, places of the probes that it is similar to), from one walk over a trie of the stored sets.

    A node of the trie stands for the grams that its sets have in common at
    their start; the overlap of these with every probe is counted once for all
    sets below. A probe goes on below a node while its overlap so far and the
    grams that are left on both sides may still reach the bound. With an owner,
    a pair is skipped if it shares a gram before it. Where sides have tails, the
    pairs are those that the tails may still make similar.
    """
    # need(a, b): the smallest overlap with 100 * overlap >= percent * (a + b - overlap).
    need = lambda a, b: -(-percent * (a + b) // (100 + percent))
    has = np.zeros((n_grams, len(probes.grams)), np.uint8)
    for k, g in enumerate(probes.grams):
        has[g, k] = 1
    flat = np.concatenate([g + k * n_grams for k, g in enumerate(probes.grams)])
    stop = np.cumsum([len(g) for g in probes.grams])
    last = np.array([g[-1] if len(g) else -1 for g in probes.grams])
    order = sorted(range(len(stored.grams)), key=lambda k: stored.grams[k].astype(">u4").tobytes())
    sets = [stored.grams[k] for k in order]
    sizes, tails, lengths = stored.sizes[order], stored.tails[order], np.array([len(s) for s in sets])
    common = np.zeros(len(sets) + 1, np.int64)
    for k in range(1, len(sets)):
        a, b = sets[k - 1], sets[k]
        m = min(len(a), len(b))
        differ = a[:m] != b[:m]
        common[k] = int(differ.argmax()) if differ.any() else m
    todo = [(0, len(sets), 0, np.arange(len(probes.grams)), np.zeros(len(probes.grams), np.int64))]
    while todo:
        lo, hi, depth, active, overlap = todo.pop()
        end = int(lengths[lo]) if hi - lo == 1 else int(common[lo + 1 : hi].min())
        edge = sets[lo][depth:end]
        if owner is not None and len(edge) and edge[0] < owner:
            apart = ~has[edge[edge < owner]][:, active].any(axis=0)
            active, overlap = active[apart], overlap[apart]
        if len(edge) and len(active):
            overlap = overlap + has[edge][:, active].sum(axis=0, dtype=np.int64)
        least, most, size = sizes[lo:hi].min(), sizes[lo:hi].max(), probes.sizes[active]
        bound = overlap + int((lengths[lo:hi] + tails[lo:hi]).max()) - end
        if end:
            path = sets[lo][:end]
            own = stop[active] - np.searchsorted(flat, active * n_grams + path[-1], "right") + probes.tails[active]
            # Grams of the path beyond a probe's last may be in its tail.
            beyond = np.where(probes.tails[active] > 0, end - np.searchsorted(path, last[active], "right"), 0)
            bound = overlap + np.minimum(own, bound - overlap + beyond)
        going = (bound >= need(size, np.maximum(least, -(-percent * size // 100)))) & (100 * most >= percent * size) & (100 * size >= percent * least)
        active, overlap, bound = active[going], overlap[going], bound[going]
        if not len(active):
            continue
        if hi - lo == 1:
            hits = active[bound >= need(probes.sizes[active], sizes[lo])]
            if len(hits):
                yield order[lo], hits
            continue
        parts = [lo, *(np.flatnonzero(common[lo + 1 : hi] == end) + lo + 1).tolist(), hi]
        todo.extend((a, b, end, active, overlap) for a, b in zip(parts[:-1], parts[1:], strict=True))


def _block(t: pa.Table, percent: int, owned: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows that it is similar to) of the two parts of a bucket that meet in t."""
    part, size, tail = (t.column(c).to_numpy() for c in ("_part", "_n", "_tail"))
    grams = t.column("_grams").combine_chunks()
    at = np.concatenate(([0], np.cumsum(grams.value_lengths().to_numpy())))
    flat = grams.flatten()
    key, weight = flat.field("g").to_numpy(), flat.field("n").to_numpy()
    distinct, first, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    # The global order is by frequency, then hash. Grams of one set alone are left out, unless they may be in a tail.
    place = np.full(len(distinct), -1, np.int64)
    used = np.flatnonzero((n > 1) | bool(tail.any()))
    place[used[np.lexsort((distinct[used], weight[first[used]]))]] = np.arange(len(used))
    places = place[back]
    sets = [x[x >= 0] for x in np.split(places, at[1:-1])]
    owner = int(place[np.searchsorted(distinct, t.column("_key")[0].as_py())]) if owned else None
    lo, hi = t.column("_lo")[0].as_py(), t.column("_hi")[0].as_py()
    probes, stored = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    if len(probes) and len(stored) and len(used):
        side = lambda rows: Side([sets[k] for k in rows], size[rows], tail[rows])
        for k, hits in shared_overlaps(side(probes), side(stored), len(used), percent, owner):
            yield int(stored[k]), probes[hits]


BY = ["_key", "_lo", "_hi"]


def _dealt(routes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, lo, hi, id, component, part): a bucket's sets dealt into parts by hash, of which each two meet."""
    sized = routes.join(sizes, "_id")
    buckets = sized.groupBy("_key").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("_size") / BLOCK_GRAMS)).cast("int").alias("_parts"), F.count("*").alias("_k")).where(F.col("_k") > 1)
    parts = routes.join(buckets.select("_key", "_parts"), "_key").withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    parts = parts.select("_key", "_id", "_component", "_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other"))
    return parts.select("_key", F.least("_part", "_other").alias("_lo"), F.greatest("_part", "_other").alias("_hi"), "_id", "_component", "_part")


def _meeting(parts: DataFrame, lists: DataFrame) -> GroupedData:
    """What meets, with its grams, dealt to as many tasks as a shuffle has, since rows are few and the work on them isn't."""
    full = parts.join(lists.select(F.col("_c").alias("_id"), "_n", "_tail", "_grams"), "_id")
    return full.repartition(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), *BY).groupBy(*BY)


def _candidates(parts: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The rows of parts that the first grams leave similar to one of another component."""

    def run(t: pa.Table) -> pa.Table:
        comp, used = t.column("_component").to_numpy(), np.zeros(t.num_rows, bool)
        for row, hits in _block(t, percent, True):
            hits = hits[comp[hits] != comp[row]]
            used[hits] = True
            used[row] |= len(hits) > 0
        return t.select([*BY, "_id", "_component", "_part"]).filter(pa.array(used))

    return _meeting(parts, heads).applyInArrow(run, "_key long, _lo int, _hi int, _id long, _component long, _part int")


def _links(parts: DataFrame, lists: DataFrame, percent: int, owned: bool) -> DataFrame:
    """(a, b): links of whole sets, as many as join the components that they join."""

    def run(t: pa.Table) -> pa.Table:
        ids, comp, links = t.column("_id").to_numpy(), t.column("_component").to_numpy(), []
        for row, hits in _block(t, percent, owned):
            for label in np.unique(comp[hits]):
                if label != comp[row]:
                    links.append((int(ids[row]), int(ids[hits[np.flatnonzero(comp[hits] == label)[0]]])))
                    comp = np.where(comp == label, comp[row], comp)
        return pa.table({"_a": pa.array([a for a, _ in links], pa.int64()), "_b": pa.array([b for _, b in links], pa.int64())})

    return _meeting(parts, lists).applyInArrow(run, "_a long, _b long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row of docs; integer ids.

    Words are split at ASCII white space with A-Z lower-cased; a row's set is its
    distinct shingles of width words, or all its words if fewer. Rows link with
    100 * intersection >= percent * union, and component_id is the smallest id
    that links reach. Null, empty and blank texts have no shingles and stand
    alone. Rows with a null id are answered, with a null component, and link
    with nothing. Rows that repeat an id are one document with several texts:
    their links meet. Other columns don't matter; an empty table gives an empty
    table. Sets are compared as 64-bit hashes.

    Rows with equal sets are one class. Similar sets lack few of each other's
    n-grams, so a class with many that no other has can't link: this is asked of
    a part of the hash space first, then of all n-grams of those left. Their sets
    are ordered by the n-grams' frequency, rarest first, and a class is routed to
    its first n-grams, as many as one more than it may lack: two similar classes
    meet at the first that they share. A pass with one route a class joins most.
    Then a class that has many n-grams of its own component alone can't link
    with another; those left are routed by the n-grams that components share.
    Where they meet, tries of their first n-grams leave few pairs, which tries of
    the whole sets decide.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = new_folder(spark, "triejoin")

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = table(sketched(texts, width), "rows")
    valid = rows.where((F.col("_n") > 0) & F.col("_id").isNotNull())
    prints = ["_f1", "_f2"]
    classes = valid.groupBy(*prints).agg(F.min("_id").alias("_least"), F.first("_n").alias("_n"), F.first("_sample").alias("_sample"), F.count("*").alias("_copies"))
    classes = table(classes.withColumn("_c", F.monotonically_increasing_id()), "classes")
    release(spark)
    lists = table(_lists(texts, classes, table, width, percent), "lists")
    for done in ("often", "left", "sets", "grams"):
        remove_folder(spark, f"{folder}/{done}")
    release(spark)

    # Similar sets have mostly the same routes, so the least of these by another hash is the same for most pairs.
    one = _heads(lists, percent).select(F.col("_c").alias("_id"), F.expr("array_min(transform(_grams, x -> named_struct('h', xxhash64(x.g), 'g', x.g))).g").alias("_key"), F.col("_c").alias("_component"))
    links = table(_links(_dealt(table(one, "one"), _sizes(lists)), lists, percent, owned=False), "links")
    parts = connected_components(links)
    release(spark)
    outside = table(_outside(lists, parts, table, percent), "outside")
    heads = table(_heads(outside, percent), "heads")
    every = heads.select(F.col("_c").alias("_id"), F.explode("_grams.g").alias("_key")).join(parts, "_id", "left").select("_key", "_id", F.coalesce("_component", "_id").alias("_component"))
    every = table(every, "routes")
    mixed = every.groupBy("_key").agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi"), F.count("*").alias("_n")).where(F.col("_lo") != F.col("_hi"))
    mixed = table(mixed.select("_key", "_n"), "mixed")
    open_routes = spread_join(every, mixed.select("_key"), ["_key"], mixed, mixed.agg(F.sum("_n")).first()[0] or 0)
    likely = table(_candidates(table(_dealt(open_routes, _sizes(heads)), "open"), heads, percent), "likely")
    release(spark)
    more = table(_links(likely, outside, percent, owned=True), "more")
    release(spark)

    # Every id's classes; texts that repeat an id link their classes.
    own = spread_join(valid.select("_id", *prints), classes.select(*prints, "_c"), prints, classes.select(*prints, F.col("_copies").alias("_n")), valid.count())
    own = table(own.select("_id", "_c").distinct(), "own")
    repeats = own.groupBy("_id").agg(F.min("_c").alias("_a"), F.count("*").alias("_k")).where(F.col("_k") > 1)
    repeats = own.join(repeats, "_id").select("_a", F.col("_c").alias("_b"))
    parts = connected_components(links.unionByName(more).unionByName(repeats)).withColumnRenamed("_id", "_c")
    joined = classes.select("_c", "_least", "_copies").join(parts, "_c").select("_c", "_component", "_least")
    least = joined.groupBy("_component").agg(F.min("_least").alias("_min"), F.count("*").alias("_n"))
    least = table(least, "least")
    joined = spread_join(joined.select("_c", "_component"), least.select("_component", "_min"), ["_component"], least.select("_component", "_n"), least.agg(F.sum("_n")).first()[0] or 0)
    smallest = table(classes.select("_c", "_least", "_copies").join(joined.select("_c", "_min"), "_c", "left").select("_c", F.coalesce("_min", "_least").alias("_component"), F.col("_copies").alias("_n")), "smallest")
    found = spread_join(own, smallest.select("_c", "_component"), ["_c"], smallest.select("_c", "_n"), valid.count()).groupBy("_id").agg(F.min("_component").alias("_component"))
    answered = rows.where(F.col("_id").isNotNull()).select("_id", "_n").join(found, "_id", "left").select("_id", "_n", F.coalesce("_component", "_id").alias("_component"))
    answered = answered.unionByName(rows.where(F.col("_id").isNull()).select("_id", "_n", F.col("_id").alias("_component")))
    out = table(answered.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id")), "out")
    for done in ("rows", "classes", "lists", "one", "links", "shared", "outside", "heads", "routes", "mixed", "open", "likely", "more", "own", "least", "smallest"):
        remove_folder(spark, f"{folder}/{done}")
    return out


def _heads(lists: DataFrame, percent: int) -> DataFrame:
    """The lists cut to their first grams, one more than those of the set that another may lack; tail counts the rest."""
    first = F.expr(f"slice(_grams, 1, cast(size(_grams) - _n + _n * {100 - percent} div 100 + 1 AS int))")
    return lists.select("_c", "_n", (F.size("_grams") - F.size(first)).cast("long").alias("_tail"), first.alias("_grams"))


def _sizes(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("_c").alias("_id"), F.size("_grams").alias("_size"))


def _outside(lists: DataFrame, parts: DataFrame, table: Callable[[DataFrame, str], DataFrame], percent: int) -> DataFrame:
    """The lists of classes that may link with one of another component, cut to the grams that other components have as well."""
    lacks = F.expr(f"_n * {100 - percent} div 100")
    found = lists.select("_c", F.explode("_grams").alias("_x")).join(parts.withColumnRenamed("_id", "_c"), "_c", "left")
    found = found.select("_c", F.col("_x.n").alias("_times"), F.col("_x.g").alias("_gram"), F.coalesce("_component", "_c").alias("_component"))
    shared = found.groupBy("_gram").agg(F.min("_component").alias("_lo"), F.max("_component").alias("_hi"), F.count("*").alias("_n")).where(F.col("_lo") != F.col("_hi"))
    shared = table(shared.select("_gram", "_n"), "shared")
    placed = spread_join(found.drop("_component"), shared.select("_gram"), ["_gram"], shared, shared.agg(F.sum("_n")).first()[0] or 0)
    cut = placed.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct(F.col("_times").alias("n"), F.col("_gram").alias("g")))).alias("_grams"))
    return cut.join(lists.select("_c", "_n"), "_c").where(F.size("_grams") >= F.col("_n") - lacks).select("_c", "_n", F.lit(0).cast("long").alias("_tail"), "_grams")


def _lists(texts: DataFrame, classes: DataFrame, table: Callable[[DataFrame, str], DataFrame], width: int, percent: int) -> DataFrame:
    """(c, n, grams) of the classes that may link: grams that others of them have, with their frequency, in the global order."""
    lacks = F.expr(f"_n * {100 - percent} div 100")
    # Two different sets that link have sizes apart by at least what a missing or added gram makes.
    able = classes.where(100 * F.col("_n") >= percent * (F.col("_n") + 1))
    found = _exploded(able.select("_c", "_sample"))
    often = table(found.groupBy("_gram").agg(F.count("*").alias("_n")).where(F.col("_n") > 1), "often")
    matched = spread_join(found, often.select("_gram"), ["_gram"], often, often.agg(F.sum("_n")).first()[0] or 0).groupBy("_c").agg(F.count("*").alias("_m"))
    left = able.select("_c", "_least", "_f1", "_f2", "_n", (F.octet_length("_sample") / 8).cast("long").alias("_s")).join(matched, "_c", "left")
    left = table(left.where(F.coalesce("_m", F.lit(0)) >= F.col("_s") - lacks).select("_c", "_least", "_f1", "_f2", "_n"), "left")

    wanted = left.select(F.col("_least").alias("_id")).distinct()
    wanted = F.broadcast(wanted) if left.count() <= BROADCAST_IDS else wanted
    sets = _whole_sets(texts.join(wanted, "_id", "left_semi"), width).groupBy("_f1", "_f2").agg(F.first("_set").alias("_set"))
    sets = table(sets.join(left, ["_f1", "_f2"]).select("_c", "_n", "_set"), "sets")
    found = _exploded(sets.select("_c", "_set"))
    grams = table(found.groupBy("_gram").agg(F.count("*").alias("_n")).where(F.col("_n") > 1), "grams")
    placed = spread_join(found, grams.withColumnRenamed("_n", "_times"), ["_gram"], grams, grams.agg(F.sum("_n")).first()[0] or 0)
    lists = placed.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct(F.col("_times").alias("n"), F.col("_gram").alias("g")))).alias("_grams"))
    return lists.join(sets.select("_c", "_n"), "_c").where(F.size("_grams") >= F.col("_n") - lacks).select("_c", "_n", F.lit(0).cast("long").alias("_tail"), "_grams")
