"""Alignment of two tokenizers: a label a byte, spans scanned by a regular expression, links counted over the corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .shared import map_arrays, new_folder, remove_folder, write_arrays

#: What ends at a byte: no token, one of A, one of B, or both.
LABELS = b"nabx"
#: A group's bytes: up to the next byte where tokens of both end.
SPAN = re.compile(rb"[nab]*x")
#: Texts are aligned together up to about so many characters; a longer text is aligned alone.
CHUNK = 1_000_000
#: Groups with more pairs than this count distinct ids first.
LARGE_GROUP = 4096
#: Pairs of ids in a file of counts.
SHARD = 2_000_000

COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups string, _pairs binary, _times binary"


class ByteLevel:
    """A byte-level BPE of a tokenizers file; strings of special tokens are plain text to it."""

    def __init__(self, path: str):
        from .packing import Encoder

        own = Encoder(path)
        self.fast, self.slow = own.fast, own.tokenizer
        self.slow.encode_special_tokens = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): bytes([b]) for b in shown} | {chr(256 + i): bytes([b]) for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = self.slow.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = b"".join(byte_of.get(c, c.encode()) for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        texts = [f" {t}" for t in texts]
        if self.fast is not None:
            return [self.fast.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.slow.encode_batch(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts the space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@dataclass(frozen=True)
class Vocabularies:
    """Files of the two tokenizers: A's of tokenizers, B's of sentencepiece."""

    a: str
    b: str


_opened: dict[tuple[type, str], object] = {}


def _open(kind: type, path: str):
    if (kind, path) not in _opened:
        _opened[kind, path] = kind(path)
    return _opened[kind, path]


class Aligner:
    """Aligns lists of texts; one a worker."""

    def __init__(self, names: Vocabularies):
        self.sides = _open(ByteLevel, names.a), _open(Pieces, names.b)
        self.lengths = [np.array([len(x) for x in s.bytes], np.int64) for s in self.sides]
        self.width = len(self.sides[1].bytes)
        most = max(len(s.bytes) for s in self.sides)
        self.shown = [f"{i}{mark}" for i in range(most) for mark in (",", "|", ";", "")]

    def whole(self, side: int, text: bytes, ids: list[int]) -> bool:
        return b"".join(map(self.sides[side].bytes.__getitem__, ids)) == text

    def align(self, texts: list[str]) -> dict[str, list]:
        """Columns of COLUMNS for texts, of which none is empty."""
        n = len(texts)
        raw = [b" " + t.encode() for t in texts]
        encoded = [s.encode(texts) for s in self.sides]
        fits = [all(self.whole(k, raw[i], encoded[k][i]) for k in (0, 1)) for i in range(n)]
        rows = [i for i in range(n) if fits[i]]
        out: dict[str, list] = {"n_a": [0] * n, "n_b": [0] * n, "n_groups": [0] * n, "n_links": [0] * n, "groups": [""] * n, "_pairs": [b""] * n, "_times": [b""] * n}
        if not rows:
            return out
        counts = [np.array([len(e[i]) for i in rows]) for e in encoded]
        ids = [np.fromiter((x for i in rows for x in e[i]), np.int64, int(c.sum())) for e, c in zip(encoded, counts, strict=True)]
        ends = [np.cumsum(length[x]) for length, x in zip(self.lengths, ids, strict=True)]
        labels = np.zeros(int(ends[0][-1]), np.uint8)
        for k in (0, 1):
            labels[ends[k] - 1] += 1 << k
        spans = np.cumsum(np.fromiter(map(len, SPAN.findall(labels.tobytes().translate(LABELS + bytes(252)))), np.int64))
        # A text's last byte ends tokens of both, so no span leaves its text.
        upto = [np.searchsorted(e, spans, "right") for e in ends]
        sizes = [np.diff(u, prepend=0) for u in upto]
        last = np.cumsum([len(raw[i]) for i in rows])
        groups_upto = np.searchsorted(spans, last, "right")
        row_of = np.repeat(np.arange(len(rows)), np.diff(groups_upto, prepend=0))
        links = np.bincount(row_of, weights=(sizes[0] * sizes[1]).astype(float), minlength=len(rows)).astype(np.int64)
        shown = self._shown(ids, sizes, upto, groups_upto)
        pairs, times, at = self._pairs(ids, sizes, upto, row_of, len(rows))
        n_groups = np.diff(groups_upto, prepend=0)
        for k, i in enumerate(rows):
            out["n_a"][i], out["n_b"][i] = int(counts[0][k]), int(counts[1][k])
            out["n_groups"][i], out["n_links"][i], out["groups"][i] = int(n_groups[k]), int(links[k]), shown[k]
            out["_pairs"][i], out["_times"][i] = pairs[at[k] : at[k + 1]].tobytes(), times[at[k] : at[k + 1]].tobytes()
        return out

    def _shown(self, ids: list[np.ndarray], sizes: list[np.ndarray], upto: list[np.ndarray], groups_upto: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        of = [np.repeat(np.arange(len(s)), s) for s in sizes]
        before = [u - s for u, s in zip(upto, sizes, strict=True)]
        place = [np.arange(len(ids[0])) + before[1][of[0]], np.arange(len(ids[1])) + upto[0][of[1]]]
        mark = [np.zeros(len(x), np.int64) for x in ids]
        mark[0][upto[0] - 1] = 1
        mark[1][upto[1] - 1] = 2
        mark[1][upto[1][groups_upto - 1] - 1] = 3
        which = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for k in (0, 1):
            which[place[k]] = ids[k] * 4 + mark[k]
        parts = list(map(self.shown.__getitem__, which.tolist()))
        stops = (upto[0] + upto[1])[groups_upto - 1].tolist()
        return ["".join(parts[lo:hi]) for lo, hi in zip([0, *stops[:-1]], stops, strict=True)]

    def _pairs(self, ids: list[np.ndarray], sizes: list[np.ndarray], upto: list[np.ndarray], row_of: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs (a * width + b) of each text, sorted, how often each is linked, and offsets by text."""
        span = np.int64(len(self.sides[0].bytes) * self.width)
        small = np.where(sizes[0] * sizes[1] <= LARGE_GROUP, sizes[1], 0)
        of_a = np.repeat(np.arange(len(sizes[0])), sizes[0])
        each = small[of_a]
        a = np.repeat(np.arange(len(ids[0])), each)
        within = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
        g = of_a[a]
        keys = [row_of[g] * span + ids[0][a] * self.width + ids[1][(upto[1] - sizes[1])[g] + within]]
        times = [np.ones(len(a), np.int64)]
        for g in np.flatnonzero(sizes[0] * sizes[1] > LARGE_GROUP):
            (ua, na), (ub, nb) = (np.unique(x[u[g] - s[g] : u[g]], return_counts=True) for x, u, s in zip(ids, upto, sizes, strict=True))
            keys.append((row_of[g] * span + ua[:, None] * self.width + ub[None, :]).ravel())
            times.append((na[:, None] * nb[None, :]).ravel())
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        times = np.add.reduceat(times, first)
        keys = keys[first]
        at = np.searchsorted(keys, np.arange(n_rows + 1) * span)
        return keys % span, times, at


_aligners: dict[Vocabularies, Aligner] = {}


def aligner(names: Vocabularies) -> Aligner:
    if names not in _aligners:
        _aligners[names] = Aligner(names)
    return _aligners[names]


def align(docs: DataFrame, names: Vocabularies, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, _pairs, _times) of each row of docs; integer ids.

    A encodes a space and the text, B the text, to which it adds the space.
    Offsets where tokens of both end cut them into groups; groups are shown as
    `a1,a2|b1;a3|b2,b3`, and every A token of a group is linked with every B
    token of it. _pairs has the distinct linked pairs as 64-bit numbers and
    _times how often the text links each; with_counts() reads them.

    Null and empty texts, and texts that one of the tokenizers doesn't give back
    byte by byte, have no tokens: zeros and an empty string. Rows that repeat an
    id, or have none, are answered one by one; other columns are left out. A
    text is held whole in one task with all its pairs.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(names)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                    size += len(texts[hi])
                    hi += 1
                full = [i for i in range(lo, hi) if texts[i]]
                made = own.align([texts[i] for i in full]) if full else {}
                columns = [batch.column(0).slice(lo, hi - lo)]
                for kind, (name, nothing) in zip(kinds, [("n_a", 0), ("n_b", 0), ("n_groups", 0), ("n_links", 0), ("groups", ""), ("_pairs", b""), ("_times", b"")], strict=True):
                    values = [nothing] * (hi - lo)
                    for i, v in zip(full, made.get(name, []), strict=True):
                        values[i - lo] = v
                    columns.append(pa.array(values, kind))
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_a", "n_b", "n_groups", "n_links", "groups", "_pairs", "_times"])
                lo = hi

    made = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"_id long, {COLUMNS}")
    return made.withColumnRenamed("_id", id_col)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit numbers of a binary column, one after the other, and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.int64), np.array([len(v) // 8 for v in values], np.int64)


def pair_counts(aligned: DataFrame, names: Vocabularies) -> DataFrame:
    """(a, b, documents): in how many rows of align() each pair of ids is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(_numbers(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["_pair", "_n"])

    width = len(_open(Pieces, names.b).bytes)
    counted = aligned.select("_pairs").mapInArrow(run, "_pair long, _n long").groupBy("_pair").agg(F.sum("_n").alias("documents"))
    return counted.select(F.expr(f"int(_pair div {width})").alias("a"), F.expr(f"int(_pair % {width})").alias("b"), "documents")


def with_counts(aligned: DataFrame, names: Vocabularies, shard: int = SHARD) -> DataFrame:
    """The rows of align() without _pairs and _times, and with n_best and count_sum.

    A pair's count is the number of rows that link it. n_best counts a row's
    links whose count is the highest of their A id, ties included; count_sum is
    the sum of counts over its links. Counts lie in files of about shard pairs in
    the shared folder, all pairs of an A id in one, and workers map them; there
    are at most as many pairs as the product of the vocabularies.
    """
    spark, width = aligned.sparkSession, len(_open(Pieces, names.b).bytes)
    folder = new_folder(spark, "alignment")
    aligned.write.option("compression", "zstd").parquet(f"{folder}/rows")
    rows = spark.read.schema(aligned.schema).parquet(f"{folder}/rows")
    pair_counts(rows, names).write.parquet(f"{folder}/counts")
    counts = spark.read.schema("a int, b int, documents long").parquet(f"{folder}/counts")
    shards = max(1, -(-counts.count() // shard))

    def store(t: pa.Table) -> pa.Table:
        a, b, n = (t.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "documents"))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(a)))
        k = t.column("_shard")[0].as_py()
        write_arrays(f"{folder}/shards/{k}", [a * width + b, n, best.astype(np.uint8)])
        return pa.table({"_shard": pa.array([k], pa.int32())})

    dealt = counts.withColumn("_shard", F.pmod("a", F.lit(shards)).cast("int"))
    there = sorted(r[0] for r in dealt.groupBy("_shard").applyInArrow(store, "_shard int").collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {k: map_arrays(f"{folder}/shards/{k}") for k in there}
        for batch in batches:
            pairs, each = _numbers(batch.column("_pairs"))
            times = _numbers(batch.column("_times"))[0]
            count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
            where = pairs // width % shards
            for k in np.unique(where):
                at = np.flatnonzero(where == k)
                keys, n, top = files[int(k)]
                place = np.searchsorted(keys, pairs[at])
                count[at], best[at] = n[place], top[place] > 0
            upto = np.concatenate(([0], np.cumsum(each)))
            sums = [np.diff(np.concatenate(([0], np.cumsum(x)))[upto]) for x in (times * best, times * count)]
            kept = [batch.column(c) for c in names_kept]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(s) for s in sums)], names=[*names_kept, "n_best", "count_sum"])

    names_kept = [c for c in rows.columns if c not in ("_pairs", "_times")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names_kept) + ", n_best long, count_sum long"
    rows.mapInArrow(run, schema).write.parquet(f"{folder}/out")
    for done in ("rows", "counts", "shards"):
        remove_folder(spark, f"{folder}/{done}")
    return spark.read.parquet(f"{folder}/out")
