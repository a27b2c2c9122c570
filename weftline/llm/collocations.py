"""Phrases whose words go together, mined by pivots: a text goes in windows to the rarest word of each n-gram."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, spread_join
from .shared import map_arrays, new_folder, remove_folder, write_arrays
from .tokens import _FOLD, _power_tables, chunks, mix

_U = np.uint64
#: Texts are read in chunks of about so many bytes.
CHUNK = 6_000_000
#: Words of the vocabulary in a file.
SHARD = 1_000_000
#: Windows that a task mines, about.
TARGET = 1_000_000
#: A pivot with more occurrences than this is dealt to tasks of its own.
HOT_PIVOT = 250_000

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK


@dataclass
class Words:
    """The words of a chunk in order; follows says that a word stands right after the one before in its piece."""

    keys: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    follows: np.ndarray
    data: np.ndarray

    def strings(self, which: np.ndarray) -> pa.Array:
        size = self.ends[which] - self.starts[which]
        upto = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(upto[-1]) + np.repeat(self.starts[which] - upto[:-1], size)
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(self.data[at])))


def words_of(data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> Words:
    """Words between blanks and piece ends, A-Z lower-cased; a key is the word's 64-bit hash with its row's seed."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return Words(none.astype(_U), none, none, none, none.astype(bool), data)
    data, kind = _FOLD[data], _KIND[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    if not len(starts):
        return Words(none.astype(_U), none, none, none, none.astype(bool), data)
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
    rows = np.searchsorted(offsets, starts, "right") - 1
    keys = mix(mix((total[ends] - total[starts]) * down[starts]) ^ seeds[rows])
    breaks = np.concatenate(([0], np.cumsum(kind == _BREAK)))
    follows = np.zeros(len(starts), bool)
    follows[1:] = (rows[1:] == rows[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return Words(keys, rows, starts, ends, follows, data)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words]]:
    """(languages of the rows, words) of each chunk of (language, text)."""
    for batch in batches:
        langs = batch.column(0)
        for lo, hi, data, offsets in chunks(batch.column(1), CHUNK):
            own = langs.slice(lo, hi - lo)
            seed = {x: _U(int.from_bytes(hashlib.blake2b((x or "").encode(), digest_size=8).digest(), "little")) for x in own.unique().to_pylist()}
            yield own, words_of(data, offsets, np.array([seed[x] for x in own.to_pylist()], _U))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, key, n) of every word of (lang, text), and each language's total under a null word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, w in _read(batches):
            keys, first, n = np.unique(w.keys, return_index=True, return_counts=True)
            names, totals = np.unique(np.array(langs.to_pylist(), object)[w.rows], return_counts=True) if len(w.rows) else ([], [])
            columns = [
                pa.concat_arrays([langs.take(pa.array(w.rows[first])), pa.array(list(names), pa.string())]),
                pa.concat_arrays([w.strings(first), pa.nulls(len(names), pa.string())]),
                pa.concat_arrays([pa.array(keys.view(np.int64)), pa.nulls(len(names), pa.int64())]),
                pa.array(np.concatenate((n, np.array(totals, np.int64)))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "key", "n"])

    counted = texts.mapInArrow(run, "lang string, word string, key long, n long")
    return counted.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """The frequent words in files by the high bits of their keys; a word's id is its place over all files."""

    folder: str
    bits: int
    first_ids: tuple[tuple[int, int], ...]
    size: int

    @property
    def kind(self) -> type:
        return np.int32 if self.size < 2**31 else np.int64


class Lexicon:
    """A vocabulary's files, mapped by a worker."""

    def __init__(self, v: Vocabulary):
        self.bits = v.bits
        self.files = {k: (first, map_arrays(f"{v.folder}/words/{k}")) for k, first in v.first_ids}

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each key; -1 and 0 if the word isn't frequent."""
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        where = (keys >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        for k, (first, (own, n, *_)) in self.files.items():
            at = np.flatnonzero(where == k)
            place = np.minimum(np.searchsorted(own, keys[at]), len(own) - 1)
            hit = own[place] == keys[at]
            ids[at[hit]], counts[at[hit]] = place[hit] + first, n[place[hit]]
        return ids, counts

    def entries(self, ids: np.ndarray) -> dict[int, tuple[str, str, int]]:
        """(language, word, count) by id, of distinct ids."""
        out = {}
        for first, (own, n, lang_at, langs, word_at, words) in self.files.values():
            for i in ids[(ids >= first) & (ids < first + len(own))].tolist():
                k = i - first
                out[i] = (langs[lang_at[k] : lang_at[k + 1]].tobytes().decode(), words[word_at[k] : word_at[k + 1]].tobytes().decode(), int(n[k]))
        return out


_lexicons: dict[str, Lexicon] = {}


def lexicon(v: Vocabulary) -> Lexicon:
    """One a worker: the last vocabulary that was asked for."""
    if v.folder not in _lexicons:
        _lexicons.clear()
        _lexicons[v.folder] = Lexicon(v)
    return _lexicons[v.folder]


def _joined(values: list[str]) -> list[np.ndarray]:
    raw = [v.encode() for v in values]
    return [np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64))).astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)]


def vocabulary(frequent: DataFrame, folder: str, shard: int) -> Vocabulary:
    """Writes (lang, word, key, n) into files of about shard words; the driver learns their sizes only."""
    bits = max(0, (-(-frequent.count() // shard) - 1).bit_length())

    def store(t: pa.Table) -> pa.Table:
        keys = t.column("key").to_numpy().view(_U)
        t = t.take(pa.array(np.argsort(keys)))
        keys = np.sort(keys)
        if len(keys) > 1 and (keys[1:] == keys[:-1]).any():
            raise ValueError("two words share a 64-bit key")
        k = t.column("_shard")[0].as_py()
        write_arrays(f"{folder}/words/{k}", [keys, t.column("n").to_numpy(), *_joined(t.column("lang").to_pylist()), *_joined(t.column("word").to_pylist())])
        return pa.table({"_shard": pa.array([k], pa.int64()), "_size": pa.array([len(keys)], pa.int64())})

    dealt = frequent.withColumn("_shard", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    sizes = sorted(map(tuple, dealt.groupBy("_shard").applyInArrow(store, "_shard long, _size long").collect()))
    upto = np.concatenate(([0], np.cumsum([n for _, n in sizes], dtype=np.int64))).tolist()
    return Vocabulary(folder, bits, tuple((k, first) for (k, _), first in zip(sizes, upto, strict=False)), upto[-1])


def _windows(w: Words, ids: np.ndarray, counts: np.ndarray, reach: int, kind: type) -> np.ndarray:
    """A row for each word: itself in the middle and up to reach neighbours on either side, else -1.

    Neighbours go as far as the piece, frequent words, and words that aren't
    rarer than the middle. On the left they stop before the middle's own word as
    well, so that an n-gram is owned by the first place of its rarest word.
    """
    n = len(ids)
    out = np.full((n, 2 * reach + 1), -1, kind)
    out[:, reach] = ids
    for side in (-1, 1):
        fits = ids >= 0
        for d in range(1, min(reach, n - 1) + 1):
            mid, other = (slice(d, n), slice(0, n - d)) if side < 0 else (slice(0, n - d), slice(d, n))
            step = w.follows[1 : n - d + 1] if side < 0 else w.follows[d:n]
            a, b = ids[mid], ids[other]
            ok = step & (b >= 0) & ((counts[other] > counts[mid]) | ((counts[other] == counts[mid]) & (b < a)))
            if side > 0:
                ok |= step & (b == a)
            held = np.zeros(n, bool)
            held[mid] = fits[mid] & ok
            fits = held
            out[mid, reach + side * d] = np.where(fits[mid], b, -1)
    return out[(out[:, reach - 1] >= 0) | (out[:, reach + 1] >= 0)]


def _key_of(grams: np.ndarray) -> np.ndarray:
    key = np.zeros(len(grams), _U)
    for c in range(grams.shape[1]):
        key = mix(key * _U(0x9E3779B97F4A7C15) + grams[:, c].astype(np.int64).view(_U) + _U(1))
    return key


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, their sums of n, and for each row its place among them."""
    keys, first, back = np.unique(_key_of(grams), return_index=True, return_inverse=True)
    own = grams[first]
    if (own[back] != grams).any():  # two rows share a hash
        own, back = np.unique(grams, axis=0, return_inverse=True)
        back = back.ravel()
    sums = np.zeros(len(own), np.int64)
    np.add.at(sums, back, n)
    return own, sums, back


def _pack(windows: np.ndarray, n: np.ndarray) -> bytes:
    """Bytes of windows and their counts: planes of equal bytes together, compressed."""
    planes = [np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes() for x in (np.ascontiguousarray(windows.T).ravel(), n)]
    raw = b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(data: bytes, width: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), np.uint8)
    size = np.dtype(kind).itemsize
    rows = len(raw) // (width * size + 8)
    cells = np.ascontiguousarray(raw[: rows * width * size].reshape(size, -1).T).view(kind).ravel()
    n = np.ascontiguousarray(raw[rows * width * size :].reshape(8, -1).T).view(np.int64).ravel()
    return cells.reshape(width, rows).T, n


def routed(texts: DataFrame, v: Vocabulary, reach: int, target: int, hot: int, words: int) -> DataFrame:
    """(target, blob): windows of (lang, text) for the task that mines their middle word.

    Middle words are dealt over targets by hash; one with more than hot
    occurrences goes to several targets of its own, by window.
    """
    targets = max(1, -(-words // target))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicon(v)
        for _, w in _read(batches):
            ids, counts = own.ids(w.keys)
            windows, n, _ = _summed(made := _windows(w, ids, counts, reach, v.kind), np.ones(len(made), np.int64))
            if not len(windows):
                continue
            middle = windows[:, reach].astype(np.int64)
            known, at = np.unique(ids, return_index=True)
            count = counts[at][np.searchsorted(known, middle)]
            to = (mix(middle.view(_U)) % _U(targets)).astype(np.int64)
            split = count > hot
            parts = -(-count[split] // hot)
            to[split] = -1 - (middle[split] * (1 << 20) + (_key_of(windows[split]) % parts.astype(_U)).astype(np.int64))
            order = np.argsort(to, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], to[order][1:] != to[order][:-1], [True])))
            blobs = [_pack(windows[order[lo:hi]], n[order[lo:hi]]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to[order[edges[:-1]]]), pa.array(blobs, pa.binary())], names=["target", "blob"])

    return texts.mapInArrow(run, "target long, blob binary")


def mined(windows: DataFrame, v: Vocabulary, longest: int, least: int) -> DataFrame:
    """(lang, phrase, a, counts) of n-grams of 2 to longest words, by target; counts are those of their words.

    A target has all windows of its words, so a longer n-gram is only counted
    if the n-grams of its middle word inside it are frequent; targets of split
    words give all their n-grams, to be summed.
    """
    reach = longest - 1

    def mine(t: pa.Table) -> pa.Table:
        bound = least if t.column("target")[0].as_py() >= 0 else 1
        parts = [_unpack(b.as_py(), 2 * reach + 1, v.kind) for b in t.column("blob")]
        rows, n, _ = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        frequent = {(reach, 1): np.ones(len(rows), bool)}
        grams, sums = [], []
        for size in range(2, longest + 1):
            which, slots = [], []
            for start in range(reach - size + 1, reach + 1):
                inside = [frequent[s, size - 1] for s in (start, start + 1) if (s, size - 1) in frequent]
                ok = (rows[:, start] >= 0) & (rows[:, start + size - 1] >= 0) & np.logical_and.reduce(inside)
                which.append(np.flatnonzero(ok))
                slots.append(start)
            own, total, back = _summed(np.concatenate([rows[at, s : s + size] for at, s in zip(which, slots, strict=True)]), np.concatenate([n[at] for at in which]))
            keep, done = total >= bound, 0
            for at, s in zip(which, slots, strict=True):
                frequent[s, size] = np.zeros(len(rows), bool)
                frequent[s, size][at] = keep[back[done : done + len(at)]]
                done += len(at)
            grams.append(own[keep])
            sums.append(total[keep])
        words = lexicon(v).entries(np.unique(np.concatenate([g.ravel() for g in grams]).astype(np.int64)))
        made = [[words[i] for i in gram] for own in grams for gram in own.tolist()]
        columns = {
            "lang": pa.array([m[0][0] for m in made], pa.string()),
            "phrase": pa.array([" ".join(x[1] for x in m) for m in made], pa.string()),
            "a": pa.array(np.concatenate(sums)),
            "counts": pa.array([[x[2] for x in m] for m in made], pa.list_(pa.int64())),
        }
        return pa.table(columns)

    found = windows.groupBy("target").applyInArrow(mine, "lang string, phrase string, a long, counts array<long>")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a"), F.first("counts").alias("counts")).where(F.col("a") >= least)


def scored(grams: DataFrame, inner: DataFrame, folder: str, percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the grams that no longer one holds nearly as often.

    inner has a row for each phrase of two words or more inside a longer gram:
    (lang, phrase, _longer, _whole, _i, _s), its place in words. Those at an end
    give the counts of a cut; all learn the largest count of what holds them.
    """
    spark = grams.sparkSession
    at_cut = F.col("_at_cut")
    inner.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longest"), F.sum(at_cut.cast("long")).alias("_n")).write.parquet(f"{folder}/inside")
    inside = spark.read.parquet(f"{folder}/inside")
    needed = inner.where(at_cut).select("lang", "phrase", "_whole", "_i", "_s")
    found = spread_join(needed, grams.select("lang", "phrase", F.col("a").alias("_c")), ["lang", "phrase"], inside.where(F.col("_n") > 0).select("lang", "phrase", "_n"), inside.agg(F.sum("_n")).first()[0] or 0)
    found = found.groupBy("lang", F.col("_whole").alias("phrase")).agg(F.collect_list(F.struct("_i", "_s", "_c")).alias("_parts"))
    lr = grams.join(found, ["lang", "phrase"], "left").join(inside.select("lang", "phrase", "_longest"), ["lang", "phrase"], "left")
    kept = lr.where(F.expr(f"_longest IS NULL OR cast(100 AS decimal(3,0)) * cast(_longest AS decimal(19,0)) < cast({percent} AS decimal(3,0)) * cast(a AS decimal(19,0))"))
    sides = """transform(sequence(1, size(counts) - 1), k -> named_struct('k', k,
      'l', if(k = 1, get(counts, 0), get(filter(_parts, x -> x._i = 0 AND x._s = k), 0)._c),
      'r', if(k = size(counts) - 1, get(counts, k), get(filter(_parts, x -> x._i = k AND x._s = size(counts) - k), 0)._c)))"""
    exact = "cast(2000000 AS decimal(7,0)) * cast(a AS decimal(19,0)) div (cast(x.l AS decimal(19,0)) + cast(x.r AS decimal(19,0)))"
    cut = F.expr(f"array_min(transform({sides}, x -> named_struct('score', {exact}, 'k', x.k, 'l', x.l, 'r', x.r)))")
    return kept.select("lang", "phrase", "a", cut.alias("_cut")).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")


def phrases_inside(grams: DataFrame) -> DataFrame:
    """The rows of inner for scored(): contiguous parts of two words or more of the grams of three or more."""
    places = F.expr("flatten(transform(sequence(2, size(counts) - 1), s -> transform(sequence(0, size(counts) - s), i -> named_struct('i', i, 's', s))))")
    long = grams.where(F.size("counts") > 2).select("lang", "phrase", "a", F.size("counts").alias("_k"), F.explode(places).alias("_at"))
    part = F.array_join(F.slice(F.split("phrase", " "), F.col("_at.i") + 1, F.col("_at.s")), " ")
    at_cut = (F.col("_at.i") == 0) | (F.col("_at.i") + F.col("_at.s") == F.col("_k"))
    return long.select("lang", part.alias("phrase"), F.col("a").alias("_longer"), F.col("phrase").alias("_whole"), F.col("_at.i").alias("_i"), F.col("_at.s").alias("_s"), at_cut.alias("_at_cut"))


def best(rows: DataFrame, top: int, parts: int = 64) -> DataFrame:
    """The first top rows of each language with their rank; first among parts of a language, then among what these leave."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    return first.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, percent: int = 80, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD, target: int = TARGET, hot: int = HOT_PIVOT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases of 2 to longest words.

    A-Z are lower-cased, texts are split into pieces at .,;:!? and line ends,
    and pieces into words at blanks and tabs. All is per language: n counts
    words, a the places of a phrase that occurs least times or more. Of its cuts
    into a first part and the rest, which occur l and r times, the one with the
    lowest floor(2000000 a / (l + r)) counts, ties to the shortest first part. A
    phrase goes if a longer one around it occurs percent of its times or more.
    Ranks go by score, a, then the phrase by bytes.

    Each place of a frequent word is routed, with neighbours that are no rarer,
    to the task of that word, which counts the n-grams whose rarest word it is;
    words with more than hot places are dealt to several tasks. Frequent words
    lie in files in the shared folder that workers map: about 40 bytes each.

    Null text has no words, a null language counts as `und`, repeated rows count
    as often as they stand, other columns don't matter, and an empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    folder = new_folder(spark, "collocations")

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    counted = table(word_counts(texts).where(F.col("word").isNull() | (F.col("n") >= least)), "counts")
    totals = counted.where(F.col("word").isNull()).select("lang", "n")
    v = vocabulary(counted.where(F.col("word").isNotNull()), folder, shard)
    windows = routed(texts, v, longest - 1, target, hot, totals.agg(F.sum("n")).first()[0] or 0)
    grams = table(mined(windows, v, longest, least), "grams")
    inner = table(phrases_inside(grams), "inner")
    ranked = best(scored(grams, inner, folder, percent), top).join(totals, "lang")
    out = table(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "out")
    for done in ("counts", "words", "grams", "inner", "inside"):
        remove_folder(spark, f"{folder}/{done}")
    return out
