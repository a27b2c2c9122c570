"""Language-model scoring with an Elias-Fano trie of words, pairs and triples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, bound_batches, cut, fold_of, release, row_key
from .eliasfano import EliasFano, Ranges
from .shared import map_arrays, new_folder, remove_folder, write_arrays
from .tokens import chunks, hashed_words, mix

_U = np.uint64
BITS = 21  # of a class; three make a key
#: Files of the vocabulary: a word's is named by the top bits of its hash.
PART_BITS = 6
END, UNKNOWN, FIRST_WORD = 0, 1, 2  # END also stands before the first word


@dataclass(frozen=True)
class Limits:
    """What a model may hold of words, reached by raising the least count, never by skipping text; n-grams have no bound.

    vocabulary: words mapped by every worker with their counts, the most frequent ones; the counts of others are joined.
    classes: words with a class of their own in the trie; others share the unknown class, inside which their own counts tell them apart.
    least: count from which pairs and triples are in the trie; 1 keeps all. Those below it count in their contexts, and their mass goes to the shorter context.
    shards: of the trie at least; more where one would hold over bucket pairs and triples.
    group: bytes of shards mapped at once; a larger trie is scored group by group.
    """

    vocabulary: int = 1 << 24
    classes: int = 1 << 20
    least: int = 2
    shards: int = 16
    bucket: int = 2_000_000
    group: int = 2 << 30


def _least_count(histogram: list[tuple[int, int]], room: int, least: int = 1) -> int:
    """The smallest count, at least `least`, so that at most room items have it or more."""
    total, best = 0, None
    for count, n in sorted(histogram, reverse=True):
        total += n
        if total > room:
            return max(least, count + 1)
        best = count
    return least if best is None else max(least, 1)


# Counting


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of the texts; word is a 64-bit hash, and the row with a null word counts texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                h, _ = hashed_words(data, offsets)
                word, n = np.unique(h, return_counts=True)
                words = pa.concat_arrays([pa.array(word.view(np.int64)), pa.nulls(1, pa.int64())])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.append(n, hi - lo))], names=["_word", "_n"])

    counted = docs.select(F.col(text_col)).mapInArrow(run, "_word long, _n long")
    return counted.groupBy("_word").agg(F.sum("_n").alias("_n"))


@dataclass(frozen=True)
class Totals:
    """What the driver holds of the words: sums, and how many words with a class have each count, the most frequent first."""

    tokens: int
    types: int
    rare_tokens: int
    rare_types: int
    texts: int
    complete: bool
    histogram: tuple[tuple[int, int], ...]

    def class_counts(self) -> np.ndarray:
        """Tokens of each class; classes are in the order of their counts."""
        n, k = np.array(self.histogram, np.int64).reshape(-1, 2).T
        return np.concatenate(([self.texts, self.rare_tokens], np.repeat(n, k)))


def _part_of(word: np.ndarray) -> np.ndarray:
    return (word >> _U(64 - PART_BITS)).astype(np.int64)


def write_vocabulary(counts: DataFrame, limits: Limits, folder: str) -> tuple[Totals, list[int]]:
    """Writes the most frequent words, at most limits.vocabulary, as files by hash range; counts is from word_counts().

    Gives the totals and which files there are. Each file has sorted hashes,
    counts and classes. A word's class is its rank by count, then file, then
    hash; only how many words of a file have a count comes to the driver, and
    only for words with a class.
    """
    words = counts.where(F.col("_word").isNotNull())
    histogram = [(r["_n"], r["k"]) for r in words.groupBy("_n").agg(F.count("*").alias("k")).collect()]
    n_texts = counts.where(F.col("_word").isNull()).agg(F.sum("_n")).first()[0] or 0
    tokens, types = sum(n * k for n, k in histogram), sum(k for _, k in histogram)
    classed = _least_count(histogram, limits.classes, 2)
    known = min(_least_count(histogram, limits.vocabulary), classed)
    part = F.shiftrightunsigned("_word", 64 - PART_BITS).cast("int").alias("_part")
    ranks = words.where(F.col("_n") >= classed).groupBy("_n", part).agg(F.count("*").alias("k")).toArrow()
    n_of, part_of, k = (ranks.column(c).to_numpy() for c in range(3))
    order = np.lexsort((part_of, -n_of))
    n_of, part_of, k = n_of[order], part_of[order], k[order]
    first = np.concatenate(([0], np.cumsum(k)))[:-1].astype(np.int64) + FIRST_WORD

    def write(t: pa.Table) -> pa.Table:
        own_part = t.column("_part")[0].as_py()
        hashes, n = t.column("_word").to_numpy().view(_U), t.column("_n").to_numpy()
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
        classes = np.full(len(n), UNKNOWN, np.uint32)
        own = np.flatnonzero(n >= classed)
        own = own[np.argsort(-n[own], kind="stable")]
        here = part_of == own_part  # counts downwards, as own is
        size = k[here]
        within = np.arange(len(own)) - np.repeat(np.concatenate(([0], np.cumsum(size)))[:-1].astype(np.int64), size)
        classes[own] = np.repeat(first[here], size) + within
        write_arrays(f"{folder}/words-{own_part}", [hashes, n.astype(np.int64), classes])
        return pa.table({"part": pa.array([own_part], pa.int32()), "n": pa.array([len(n)], pa.int64())})

    made = words.where(F.col("_n") >= known).select("_word", "_n", part).groupBy("_part").applyInArrow(write, "part int, n long").collect()
    in_class, n_own = sum(n * c for n, c in histogram if n >= classed), sum(c for n, c in histogram if n >= classed)
    top = tuple(sorted(((n, c) for n, c in histogram if n >= classed), reverse=True))
    totals = Totals(tokens + n_texts, types + bool(n_texts), tokens - in_class, types - n_own, n_texts, sum(r["n"] for r in made) == types, top)
    return totals, sorted(r["part"] for r in made)


class Vocabulary:
    """Sorted word hashes with counts and classes, mapped from files by hash range."""

    def __init__(self, files: dict[int, list[np.ndarray]]):
        self.files = files

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of an array, which of them each is, and of each distinct word whether it is held, its count and class."""
        distinct, at = np.unique(words, return_inverse=True)
        held, count, cls = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64), np.full(len(distinct), UNKNOWN, np.int64)
        cuts = np.searchsorted(_part_of(distinct), np.arange((1 << PART_BITS) + 1))
        for part, (hashes, counts, classes) in self.files.items():
            own = slice(cuts[part], cuts[part + 1])
            x = distinct[own]
            if len(x):
                place = np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)
                hit = hashes[place] == x
                held[own], count[own], cls[own] = hit, np.where(hit, counts[place], 0), np.where(hit, classes[place], UNKNOWN)
        return distinct, at, held, count, cls


def _sequences(classes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with END before and after each row's words, the row of each, and the places of the first ones."""
    size = np.bincount(rows, minlength=n_rows) + 2
    start = np.concatenate(([0], np.cumsum(size)))
    out = np.full(start[-1], END, np.int64)
    inner = np.ones(len(out), bool)
    inner[start[:-1]] = False
    inner[start[1:] - 1] = False
    out[inner] = classes
    return out, np.repeat(np.arange(n_rows), size), start


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and their counts, byte planes apart."""
    steps = np.diff(keys, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(steps + counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    steps, counts = (np.ascontiguousarray(x.T).view(np.int64).ravel() for x in data.reshape(2, 8, -1))
    return np.cumsum(steps), counts


def _summed(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpacked(b) for b in blobs]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def ngram_counts(docs: DataFrame, load: Callable[[], Vocabulary], limits: Limits, tokens: int, text_col: str) -> DataFrame:
    """(level, bucket, n1, n2, kept, blob): keys seen limits.least times or more by hashed bucket; level 2 pairs, 3 triples.

    Each chunk of text is counted before the shuffle, and a bucket holds about
    limits.bucket occurrences at most, whatever the words.
    """
    n_buckets = max(8, -(-tokens // limits.bucket))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = load()
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                h, rows = hashed_words(data, offsets)
                _, at, _, _, classes = words.look_up(h)
                seq, row, _ = _sequences(classes[at], rows, hi - lo)
                for level in (2, 3):
                    whole = row[: 1 - level] == row[level - 1 :]
                    keys = seq[: 1 - level][whole]
                    for k in range(1, level):
                        keys = keys << BITS | seq[k : len(seq) - level + 1 + k][whole]
                    keys, n = np.unique(keys, return_counts=True)
                    bucket = (mix(keys.view(_U)) % _U(n_buckets)).astype(np.int64)
                    order = np.argsort(bucket.astype(np.uint16) if n_buckets < 65_536 else bucket, kind="stable")
                    keys, n, bucket = keys[order], n[order], bucket[order]
                    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(keys) else np.zeros(1, int)
                    blobs = [_packed(keys[i:j], n[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), level, np.int32)), pa.array(bucket[cuts[:-1]]), pa.array(blobs, pa.binary())], names=["_level", "_bucket", "_blob"])

    def add(t: pa.Table) -> pa.Table:
        keys, n = _summed(t.column("_blob").to_pylist())
        kept = n >= limits.least
        row = [t.column("_level")[0].as_py(), t.column("_bucket")[0].as_py(), int((n == 1).sum()), int((n == 2).sum()), int(kept.sum()), _packed(keys[kept], n[kept])]
        return pa.table([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["_level", "_bucket", "n1", "n2", "kept", "_blob"])

    found = docs.select(F.col(text_col)).mapInArrow(count, "_level int, _bucket long, _blob binary")
    return found.groupBy("_level", "_bucket").applyInArrow(add, "_level int, _bucket long, n1 long, n2 long, kept long, _blob binary")


# The trie


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, codebook) of logs: 256 bins of about as many values, each stood for by its mean."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    edges = np.unique(np.quantile(values, np.arange(1, 256) / 256))
    codes = np.searchsorted(edges, values, "right")
    n = np.bincount(codes, minlength=256)
    return codes.astype(np.uint8), (np.bincount(codes, values, minlength=256) / np.maximum(n, 1)).astype(np.float32)


def _log_unigrams(class_counts: np.ndarray) -> np.ndarray:
    """log10 probability of each class: its count and a half, over all classes."""
    n = class_counts.astype(float)
    return np.log10((n + 0.5) / (n.sum() + 0.5 * len(n)))


def _rows_below(mass: np.ndarray) -> np.ndarray:
    return np.log10(np.clip(mass, 1e-12, 1.0))


def build_shard(pairs: tuple, contexts: tuple, triples: tuple, class_counts: np.ndarray, discounts: tuple[float, float], shards: int) -> list[np.ndarray]:
    """The levels of the contexts whose last word b is in one shard.

    pairs (b << BITS | c, n); contexts (a << BITS | b, n), the pairs that end in
    such a b; triples (a, b, c packed, n). With C the count of a context, n of a
    successor, D the level's discount: P(c | context) = (n - D) / C + g(context)
    P(c | shorter), g = 1 - sum (n - D) / C over the kept successors, so that
    what was pruned goes to the shorter context.
    """
    mask, n_local = (1 << BITS) - 1, (len(class_counts) - 1) // shards + 1
    low = 10 ** _log_unigrams(class_counts)
    b, c, n = pairs[0] >> BITS, pairs[0] & mask, pairs[1].astype(float)
    own = b // shards
    order = np.lexsort((c, own))
    b, c, n, own = b[order], c[order], n[order], own[order]
    share = (n - discounts[0]) / np.maximum(class_counts[b], 1)
    rest = np.clip(1 - np.bincount(own, share, minlength=n_local), 1e-12, 1)
    p2 = share + rest[own] * low[c]
    level2 = Ranges.build(own, c, n_local)

    a, b3, c3, n3 = triples[0] >> 2 * BITS, triples[0] >> BITS & mask, triples[0] & mask, triples[1].astype(float)
    own3 = b3 // shards
    order = np.lexsort((c3, a, own3))
    a, c3, n3, own3 = a[order], c3[order], n3[order], own3[order]
    context = own3 << BITS | a
    kinds, first = np.unique(context, return_index=True)
    at = np.searchsorted(kinds, context)
    by_last = (contexts[0] & mask) // shards << BITS | contexts[0] >> BITS
    order = np.argsort(by_last)
    where = np.searchsorted(by_last[order], kinds)
    of_context = contexts[1][order][where].astype(float) if len(kinds) else np.zeros(0)
    share3 = (n3 - discounts[1]) / of_context[at]
    rest3 = np.clip(1 - np.bincount(at, share3, minlength=len(kinds)), 1e-12, 1)
    place, begin = level2.find(own3, c3)
    p3 = share3 + rest3[at] * p2[place] if len(place) else np.zeros(0)
    level_c = Ranges.build(kinds >> BITS, kinds & mask, n_local)
    relative = place - begin
    order = np.lexsort((relative, at))
    level3 = Ranges.build(at[order], relative[order], len(kinds))
    out = level2.arrays() + level_c.arrays() + level3.arrays()
    for logs in (np.log10(p2), _rows_below(rest), np.log10(p3[order]), _rows_below(rest3)):
        out += list(_quantised(logs))
    return out


class _Level:
    """Ranges whose contexts are words: few enough to keep their pointers and bases plain."""

    def __init__(self, ranges: Ranges):
        self.values = ranges.values
        n = max(0, ranges.pointers.n - 1)
        self.start = ranges.pointers.access(np.arange(n + 1)) if n else np.zeros(1, np.int64)
        self.base = np.zeros(n, np.int64)
        some = np.flatnonzero(self.start[:-1] > 0)
        if len(some) and self.values.n:
            self.base[some] = self.values.access(self.start[:-1][some] - 1) + 1

    def find(self, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo = self.start[context]
        return self.values.find(lo, self.start[context + 1], self.base[context] + ids), lo


class Trie:
    """Queries the shards held, of n in all: log10 P(c | a, b) of whole arrays."""

    def __init__(self, shards: dict[int, list[np.ndarray]], n: int, class_counts: np.ndarray):
        self.unigrams, self.held, self.n, self.shards = _log_unigrams(class_counts).astype(np.float32), list(shards), n, []
        size = 2 * EliasFano.PARTS
        for x in shards.values():
            self.shards.append((_Level(Ranges.of(x[:size])), _Level(Ranges.of(x[size : 2 * size])), Ranges.of(x[2 * size : 3 * size]), x[3 * size :]))

    def log_probabilities(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of words in text order; a is -1 where b is the start of a text, and 0 is given where b's shard isn't held.

        A pair of words is a context of the trie only if it is one of its pairs,
        so where all shards are held, what the word before has found says where
        to look for contexts.
        """
        out, n = np.zeros(len(c)), self.n
        place, begin = np.full(len(c), -1, np.int64), np.zeros(len(c), np.int64)
        shard = (b % n).astype(np.uint16 if n < 65_536 else np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(n + 1))
        parts = [order[cuts[s] : cuts[s + 1]] for s in self.held]
        for at, (level2, _, _, (p2, book2, g2, of_g2, *_)) in zip(parts, self.shards, strict=True):
            local = b[at] // n
            place[at], begin[at] = level2.find(local, c[at])
            hit = place[at] >= 0
            out[at] = np.where(hit, book2[p2[np.maximum(place[at], 0)]] if len(p2) else 0, of_g2[g2[local]] + self.unigrams[c[at]])
        known = a >= 0
        if len(self.shards) == n:
            known &= np.concatenate(([False], place[:-1] >= 0))
        for at, (_, level_c, level3, (*_, p3, book3, g3, of_g3)) in zip(parts, self.shards, strict=True):
            at = at[known[at]]
            context, _ = level_c.find(b[at] // n, a[at])
            at, context = at[context >= 0], context[context >= 0]
            if not len(at):
                continue
            out[at] += of_g3[g3[context]]
            deep, _ = level3.find(context, np.where(place[at] >= 0, place[at] - begin[at], -1))
            found = deep >= 0
            out[at[found]] = book3[p3[deep[found]]]
        return out


def build_trie(counts: DataFrame, totals: Totals, limits: Limits, folder: str) -> list[tuple[int, int]]:
    """(shard, bytes) of each shard's file: regroups all counted keys by the shard of the context's last word; a task builds and writes a shard."""
    rows = counts.groupBy("_level").agg(*[F.sum(x).alias(x) for x in ("n1", "n2", "kept")]).collect()
    discounts = []
    for level in (2, 3):
        n1, n2 = (sum(r[x] for r in rows if r["_level"] == level) for x in ("n1", "n2"))
        discounts.append(min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.75)
    kept = sum(r["kept"] for r in rows)
    shards, mask = max(limits.shards, -(-kept // limits.bucket)), (1 << BITS) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, n = _unpacked(blob)
                # pairs go by their first word, and once more, as contexts, by their second; triples by the middle one
                for kind, word in ((2, keys >> BITS), (1, keys & mask)) if level == 2 else ((3, keys >> BITS & mask),):
                    to = word % shards
                    for s in np.unique(to):
                        pick = to == s
                        yield pa.RecordBatch.from_arrays([pa.array([int(s)]), pa.array([kind], pa.int32()), pa.array([_packed(keys[pick], n[pick])], pa.binary())], names=["_shard", "_kind", "_blob"])

    def build(t: pa.Table) -> pa.Table:
        kinds, blobs = t.column("_kind").to_pylist(), t.column("_blob").to_pylist()
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        parts = []
        for kind in (2, 1, 3):
            own = [b for k, b in zip(kinds, blobs, strict=True) if k == kind and b is not None]
            parts.append(_summed(own) if own else none)
        shard = t.column("_shard")[0].as_py()
        size = write_arrays(f"{folder}/shard-{shard}", build_shard(*parts, totals.class_counts(), tuple(discounts), shards))
        return pa.table({"shard": pa.array([shard], pa.int64()), "bytes": pa.array([size], pa.int64())})

    spark = counts.sparkSession
    # Every shard is built, even one without a pair.
    dealt = counts.select("_level", "_blob").mapInArrow(deal, "_shard long, _kind int, _blob binary")
    empty = spark.range(shards).select(F.col("id").alias("_shard"), F.lit(0).alias("_kind"), F.lit(None).cast("binary").alias("_blob"))
    built = dealt.unionByName(empty).groupBy("_shard").applyInArrow(build, "shard long, bytes long")
    return sorted((r["shard"], r["bytes"]) for r in built.collect())


def _groups(sizes: list[tuple[int, int]], room: int) -> list[list[int]]:
    """Shards in order, as many a group as room bytes hold and one at least; sizes are (shard, bytes)."""
    groups, used = [], 0
    for shard, size in sorted(sizes):
        if not groups or used + size > room:
            groups.append([])
            used = 0
        groups[-1].append(shard)
        used += size
    return groups


# Workers


_mapped: dict[str, object] = {}


def _kept(folder: str, name: str, make: Callable[[], object]) -> object:
    """A worker's object of that name; those of other models go, so that a worker holds one model's words and one group of shards."""
    at = f"{folder}/{name}"
    if at not in _mapped:
        for other in list(_mapped):
            if not other.startswith(f"{folder}/") or (name != "words" and not other.endswith("/words")):
                del _mapped[other]
        _mapped[at] = make()
    return _mapped[at]


def _vocabulary(folder: str, parts: list[int]) -> Callable[[], Vocabulary]:
    return lambda: _kept(folder, "words", lambda: Vocabulary({p: map_arrays(f"{folder}/words-{p}") for p in parts}))


def _trie(folder: str, group: list[int], shards: int, totals: Totals) -> Callable[[], Trie]:
    return lambda: _kept(folder, f"shard-{group[0]}", lambda: Trie({k: map_arrays(f"{folder}/shard-{k}") for k in group}, shards, totals.class_counts()))


@dataclass
class Model:
    """A trained model: a folder under the checkpoint folder with the files of words and shards, and the counts of all words.

    Workers map the files; the driver holds their names and the totals. remove()
    deletes them once no score is to be computed any more.
    """

    folder: str
    parts: list[int]
    shards: int
    groups: list[list[int]]
    counts: DataFrame
    totals: Totals
    size: int

    def remove(self) -> None:
        remove_folder(self.counts.sparkSession, self.folder)


def train(docs: DataFrame, limits: Limits | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts all of docs and builds the trie. Null texts count as empty; an empty table gives a model that knows nothing."""
    limits, spark = limits or Limits(), docs.sparkSession
    bound_batches(docs.sparkSession)
    folder = new_folder(spark, "ngrams")
    counts = cut(word_counts(docs, id_col, text_col))
    totals, parts = write_vocabulary(counts, limits, folder)
    pairs = cut(ngram_counts(docs, _vocabulary(folder, parts), limits, totals.tokens, text_col))
    release(spark)
    sizes = build_trie(pairs, totals, limits, folder)
    return Model(folder, parts, len(sizes), _groups(sizes, limits.group), counts, totals, sum(n for _, n in sizes))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of each row; integer ids.

    Tokens are the words between ASCII white space, A-Z lower-cased, then one
    end. score is the model's log10 probability of the text; a word outside the
    trie has the probability of the unknown class times its own add-half share
    of that class, so scores are of the words themselves. base_score is the
    add-half unigram probability. Null texts are empty. Repeated rows repeat. An
    empty table gives an empty table.
    """
    words = _vocabulary(model.folder, model.parts)
    t = model.totals
    whole, rare = t.tokens + 0.5 * (t.types + 1), t.rare_tokens + 0.5 * (t.rare_types + 1)
    complete, end_count = bool(t.complete), t.texts

    def scorer(trie, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, tree = words(), trie()
            for batch in batches:
                for lo, hi, data, offsets in chunks(batch.column(3)):
                    n_rows = hi - lo
                    h, rows = hashed_words(data, offsets)
                    distinct, at, held, count, classes = own.look_up(h)
                    seq, row, _ = _sequences(classes[at], rows, n_rows)
                    c, b = seq[1:], seq[:-1]
                    a = np.concatenate(([-1], seq[:-2]))
                    a[np.concatenate(([True], row[:-2] != row[1:-1]))] = -1
                    inside = row[1:] == row[:-1]
                    logs = tree.log_probabilities(a[inside], b[inside], c[inside])
                    model_score = np.bincount(row[1:][inside], logs, minlength=n_rows)
                    keys = [batch.column(k).slice(lo, n_rows) for k in range(3)]
                    if not first:  # the first group has counted the rows and words
                        none, zero = pa.array(np.zeros(n_rows, np.int64)), pa.array(np.zeros(n_rows))
                        yield pa.RecordBatch.from_arrays([*keys, none, none, none, zero, pa.array(model_score), pa.nulls(n_rows, pa.int64())], names=names)
                        continue
                    known = (count > 0)[at]
                    # words whose counts are elsewhere are left to the join
                    settled = held | complete
                    base = np.where(settled, np.log10((count + 0.5) / whole), 0.0)
                    inner = np.where(settled & (classes == UNKNOWN), np.log10((count + 0.5) / rare), 0.0)
                    model_score += np.bincount(rows, inner[at], minlength=n_rows)
                    base_score = np.bincount(rows, base[at], minlength=n_rows) + np.log10((end_count + 0.5) / whole)
                    n_known = np.bincount(rows, known, minlength=n_rows).astype(np.int64) + (end_count > 0)
                    n_tokens = np.bincount(rows, minlength=n_rows) + 1
                    ones = pa.array(np.ones(n_rows, np.int64))
                    yield pa.RecordBatch.from_arrays([*keys, ones, pa.array(n_tokens), pa.array(n_known), pa.array(base_score), pa.array(model_score), pa.nulls(n_rows, pa.int64())], names=names)
                    if not complete:
                        open_ = np.flatnonzero(~settled[at])
                        pair, n = np.unique(rows[open_] * (len(distinct) + 1) + at[open_], return_counts=True)
                        who, which = pair // (len(distinct) + 1), pair % (len(distinct) + 1)
                        take, zero = pa.array(who), pa.array(np.zeros(len(who)))
                        yield pa.RecordBatch.from_arrays([*[k.take(take) for k in keys], pa.array(np.zeros(len(who), np.int64)), pa.array(n), pa.array(np.zeros(len(who), np.int64)), zero, zero, pa.array(distinct[which].view(np.int64))], names=names)

        return run

    names = [*KEY, "_id", "_rows", "_tokens", "_known", "_base", "_score", "_word"]
    schema = "_w_k1 long, _w_k2 long, _id long, _rows long, _tokens long, _known long, _base double, _score double, _word long"
    texts, parts = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("_id"), F.col(text_col)), []
    for i, group in enumerate(model.groups):
        part = texts.mapInArrow(scorer(_trie(model.folder, group, model.shards, t), i == 0), schema)
        parts.append(part if len(model.groups) == 1 else cut(part))  # one group at a time is mapped
    rows = reduce(DataFrame.unionByName, parts)
    if not complete:
        # rows that stand for texts join on a number of their own, not all on null; no count has a null _of
        counts = model.counts.where(F.col("_word").isNotNull()).select(F.col("_word").alias("_of"), F.col("_n").alias("_c"))
        rows = rows.withColumn("_of", F.coalesce("_word", F.xxhash64("_w_k1", "_w_k2"))).join(counts, "_of", "left")
        open_, c = F.col("_word").isNotNull(), F.coalesce("_c", F.lit(0)) + 0.5
        rows = rows.select(
            *KEY, "_id", "_rows",
            F.when(open_, 0).otherwise(F.col("_tokens")).alias("_tokens"),
            F.when(open_, F.when(F.col("_c") > 0, F.col("_tokens")).otherwise(0)).otherwise(F.col("_known")).alias("_known"),
            F.when(open_, F.col("_tokens") * F.log10(c / whole)).otherwise(F.col("_base")).alias("_base"),
            F.when(open_, F.col("_tokens") * F.log10(c / rare)).otherwise(F.col("_score")).alias("_score"),
        )
    if not complete or len(parts) > 1:
        rows = rows.groupBy(*KEY, "_id").agg(*[F.sum(x).alias(x) for x in ("_rows", "_tokens", "_known", "_base", "_score")])
        rows = rows.select("_id", *[(F.col(x) / F.col("_rows")).alias(x) for x in ("_tokens", "_known", "_base", "_score")], F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    return rows.select(F.col("_id").alias(id_col), F.col("_tokens").cast("long").alias("n_tokens"), F.col("_known").cast("long").alias("n_known"), F.col("_base").alias("base_score"), F.col("_score").alias("score"))


def training_rows(docs: DataFrame, id_col: str = "doc_id", fold: int = 1) -> DataFrame:
    """All rows outside one fold of five; a null id is in fold 0."""
    return docs.where(fold_of(id_col) != fold)
