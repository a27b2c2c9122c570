"""Words and shingles of Arrow text batches as numpy arrays, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
INVERSE = _U(pow(int(BASE), -1, 2**64))
#: Texts are handled in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK = 2_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK + CHUNK // 4)
        made = []
        for b in (BASE, INVERSE):
            p = np.full(size, b, _U)
            p[0] = 1
            made.append(np.cumprod(p, dtype=_U))
        _powers = (made[0], made[1])
    return _powers


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows; nulls are empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of each word of a chunk: A-Z lower-cased, split at ASCII white space."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    data = _FOLD[data]
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a row's start parts words as well
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return hashes, np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of width words in a row, sorted within each row, and offsets by row.

    A row with fewer words, but not none, has one shingle of them all.
    """
    per_row = np.bincount(rows, minlength=n_rows)
    factor = [mix(np.array([k + 1], _U))[0] | _U(1) for k in range(width)]
    last = len(hashes) - width + 1
    made, at = np.zeros(0, _U), np.zeros(0, np.int64)
    if last > 0:
        made = hashes[:last] * factor[0]
        for k in range(1, width):
            made = made + hashes[k : k + last] * factor[k]
        whole = rows[:last] == rows[width - 1 :]
        made, at = mix(made[whole]), rows[:last][whole]
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(per_row)))
        own = []
        for r in short:
            x = hashes[begin[r] : begin[r + 1]]
            own.append(_U(len(x)) + (x * np.array(factor[: len(x)], _U)).sum(dtype=_U))
        made, at = np.concatenate((made, mix(np.array(own, _U)))), np.concatenate((at, short))
    order = np.argsort(made)
    if n_rows <= 65_535:
        order = order[np.argsort(at[order].astype(np.uint16), kind="stable")]
    else:
        order = order[np.argsort(at[order], kind="stable")]
    made, at = made[order], at[order]
    if len(made):
        fresh = np.concatenate(([True], (made[1:] != made[:-1]) | (at[1:] != at[:-1])))
        made, at = made[fresh], at[fresh]
    return made, np.concatenate(([0], np.cumsum(np.bincount(at, minlength=n_rows))))
