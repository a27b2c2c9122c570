"""Best-fit packing of tokenised documents by the sum-of-squares rule."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut

#: Fixed value: the parts that byte-level pre-tokenization cuts a text into before merging.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces packed together in one task.
GROUP = 50_000


class Encoder:
    """Encodes texts with the vocabulary of a tokenizers file, by the faster tiktoken where both must agree.

    They agree if the file is a plain byte-level BPE whose ids follow the order
    of its merges and whose parts are those of PARTS; texts that hold the string
    of an added token, and all texts of any other file, go to tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._ranked(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def _ranked(spec: dict):
        import tiktoken

        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        odd = [spec["normalizer"], spec["truncation"], model.get("dropout"), model.get("unk_token"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges")]
        if not plain or any(odd):
            return None
        # Byte-level vocabularies write bytes that don't print as the characters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if ids != sorted(ids) or len(ranks) != 256 + len(merged):
            return None
        return tiktoken.Encoding("ranked", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(id, piece, start, length, ids_crc32, ids) of every row: the ids of its text and end_id, cut if over capacity.

    All pieces of a cut document are full except the first. Null text counts as
    empty and gives end_id alone. ids are little-endian unsigned 32-bit numbers,
    and null without with_ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[list] = [[], [], [], [], [], []]
                ids_in = part.column(0).to_pylist()
                for doc, text in zip(ids_in, part.column(1).to_pylist(), strict=True):
                    ids = np.append(own.encode(text or ""), np.uint32(end_id)).astype("<u4")
                    first = len(ids) % capacity or capacity
                    for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                        stop = first if k == 0 else start + capacity
                        for column, value in zip(rows, (doc, k, start, stop - start, crc32_of(ids[start:stop]), ids[start:stop].tobytes() if with_ids else None), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["_id", "piece", "start", "length", "ids_crc32", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given.

    An item goes where the sum, over residual gaps, of the squared counts of
    open bins becomes smallest; a new bin is one of the choices. Of equal
    choices the smallest gap is taken.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; full and untouched bins don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        if size == capacity:
            bins[i], offsets[i], n = n, 0, n + 1
            continue
        old, new = count[size:], count[: capacity - size + 1]
        # Moving a bin from gap g to g - size changes the sum by 2 (N(g - size) - N(g) + 1), by 1 - 2 N(g) if it fills it.
        change = 2 * (new - old + 1)
        change[0] = 1 - 2 * old[0]
        change[-1] = 2 * new[-1] + 1
        usable = old > 0
        usable[-1] = True
        change[~usable] = np.iinfo(np.int64).max
        gap = int(np.argmin(change)) + size
        if gap == capacity:
            where, n = n, n + 1
        else:
            where = stacks[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = where, capacity - gap
        left = gap - size
        if left:
            stacks[left].append(where)
            count[left] += 1
    return bins, offsets


def pack(items: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces(), which keep their columns.

    Full pieces take a sequence each. The others are dealt by a hash into groups
    of about group pieces, and each group is packed longest first; at most a few
    sequences a group end up less than full. The hash is of a row's place in the
    written table, so rows that share an id, or have none, are spread as well.
    """
    items = cut(items)
    parts = max(1, -(-items.count() // group))

    def run(t: pa.Table) -> pa.Table:
        length = t.column("length").to_numpy()
        keys = [t.column(c).to_numpy(zero_copy_only=False) for c in ("piece", "_id")]
        order = np.lexsort((*keys, -length))
        bins, offsets = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        bins[order], offsets[order] = sum_of_squares(length[order], capacity)
        base = t.column("_group")[0].as_py() << 32
        return t.drop_columns(["_group"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))

    dealt = items.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs.

    ids_crc32 is the crc32 of the piece's ids as little-endian unsigned 32-bit
    numbers. Every row is packed, repeated rows and rows with a null id too.
    An empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    made = pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids=False).drop("ids")
    return pack(made, capacity).withColumnRenamed("_id", id_col)


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
