"""Elias-Fano sequences with vectorised access and successor search, kept in one flat buffer."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    _ones = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_ones)] = _ones


def _select_in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th set bit (from 0) of each 64-bit word, by halves."""
    x, r, at = words.copy(), r.astype(np.uint8), np.zeros(len(words), np.uint8)
    for half in (32, 16, 8):
        below = np.bitwise_count(x & _U((1 << half) - 1))
        up = (r >= below).view(np.uint8)
        r -= below * up
        up *= np.uint8(half)
        at += up
        x >>= up
    return at + _SELECT[(x & _U(255)).astype(np.uint8), r]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, the ones before each word of those (and in all),
    and the word of each 64th one and zero to start a search from. All of it is read in place."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, hints: tuple[np.ndarray, np.ndarray]):
        self.n, self.low_bits, self.low, self.high, self.ones, self._hints = n, low_bits, low, high, ones, hints

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(_U)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(1, _U), np.zeros(1, _U), np.zeros(2, np.int64), (np.zeros(2, np.uint32), np.zeros(2, np.uint32)))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        high = np.zeros((n + (int(values[-1]) >> low_bits)) // 64 + 2, _U)
        bits = (values >> _U(low_bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, bits >> 6, _U(1) << (bits & 63).astype(_U))
        low = np.zeros(n * low_bits // 64 + 2, _U)
        if low_bits:
            x = values & _U((1 << low_bits) - 1)
            at = np.arange(n, dtype=np.int64) * low_bits
            shift = (at & 63).astype(_U)
            np.bitwise_or.at(low, at >> 6, x << shift)
            over = np.flatnonzero((at & 63) + low_bits > 64)
            np.bitwise_or.at(low, (at[over] >> 6) + 1, x[over] >> (_U(64) - shift[over]))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))
        zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
        hints = [np.minimum(np.searchsorted(c, np.arange(0, int(c[-1]) + 128, 64), "right") - 1, len(high) - 1).astype(np.uint32) for c in (ones, zeros)]
        return cls(n, low_bits, low, high, ones, tuple(hints))

    #: Arrays that make a sequence.
    PARTS = 6

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones, *self._hints]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        head, low, high, ones, *hints = arrays
        return cls(int(head[0]), int(head[1]), low, high, ones, tuple(hints))

    def _before(self, word: np.ndarray, flip: bool) -> np.ndarray:
        """Ones, or with flip zeros, before a word of the high bits."""
        return word * 64 - self.ones[word] if flip else self.ones[word]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(_U)
        x = self.low[word] >> shift
        over = self.low[word + 1] << ((_U(64) - shift) & _U(63))
        return (x | np.where(shift > 0, over, _U(0))) & _U((1 << self.low_bits) - 1)

    def _select(self, i: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the i-th one, or with flip the i-th zero, of the high bits."""
        word, last = (self._hints[flip][at].astype(np.int64) for at in (i >> 6, (i >> 6) + 1))
        live = np.flatnonzero(word < last)
        lo, hi, want = word[live], last[live], i[live]
        while len(live):  # the last word with at most i before it
            mid = (lo + hi + 1) >> 1
            up = self._before(mid, flip) <= want
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid - 1)
            done = lo >= hi
            word[live[done]] = lo[done]
            on = np.flatnonzero(~done)
            live, lo, hi, want = live[on], lo[on], hi[on], want[on]
        bits = self.high[word]
        return word * 64 + _select_in_word(~bits if flip else bits, i - self._before(word, flip))

    def _run(self, at: np.ndarray) -> np.ndarray:
        """The number of ones from place at on; 64 stands for 64 or more."""
        word, shift = at >> 6, (at & 63).astype(_U)
        follow = np.append(self.high, _U(0))[word + 1] if len(self.high) == int(word.max(initial=0)) + 1 else self.high[word + 1]
        bits = self.high[word] >> shift | np.where(shift > 0, follow << ((_U(64) - shift) & _U(63)), _U(0))
        return np.bitwise_count(bits & ~(bits + _U(1))).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, False) - i) << self.low_bits) + self._low(i).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Place in [lo, hi) at which target stands, or -1; values are distinct there."""
        out = np.full(len(target), -1, np.int64)
        target = np.asarray(target, np.int64)
        top = (self.n and int(self.access(np.array([self.n - 1]))[0])) if self.n else -1
        ask = np.flatnonzero((lo < hi) & (target >= 0) & (target <= top))
        if not len(ask):
            return out
        h = target[ask] >> self.low_bits
        zero = np.full(len(ask), -1, np.int64)  # the zero before the bucket of h
        later = np.flatnonzero(h)
        zero[later] = self._select(h[later] - 1, True)
        begin, run = zero + 1 - h, self._run(zero + 1)
        long = np.flatnonzero(run == 64)
        run[long] = self._select(h[long], True) - zero[long] - 1
        begin, end = np.maximum(begin, lo[ask]), np.minimum(begin + run, hi[ask])
        want = (target[ask] & ((1 << self.low_bits) - 1)).astype(_U)
        limit, live = end.copy(), np.flatnonzero(begin < end)
        while len(live):  # first place in the bucket whose low bits are not below want
            mid = (begin[live] + end[live]) >> 1
            below = self._low(mid) < want[live]
            begin[live[below]] = mid[below] + 1
            end[live[~below]] = mid[~below]
            live = live[begin[live] < end[live]]
        there = np.flatnonzero(begin < limit)
        hit = there[self._low(begin[there]) == want[there]]
        out[ask[hit]] = begin[hit]
        return out


class Ranges:
    """Sorted lists of distinct ids, one a context: pointers and successors, both monotone.

    A list's ids are stored relative to its context: on top of one more than
    the last value of the list before it.
    """

    def __init__(self, pointers: EliasFano, values: EliasFano):
        self.pointers, self.values = pointers, values

    @classmethod
    def build(cls, owner: np.ndarray, ids: np.ndarray, n: int) -> Ranges:
        """owner and ids sorted by both; owner below n."""
        size = np.bincount(owner, minlength=n)
        start = np.concatenate(([0], np.cumsum(size)))
        full = np.flatnonzero(size)
        widths = ids[start[full + 1] - 1] + 1
        base = np.concatenate(([0], np.cumsum(widths)))[:-1].astype(np.int64)
        return cls(EliasFano.build(start), EliasFano.build(ids + np.repeat(base, size[full]) if len(full) else ids))

    def arrays(self) -> list[np.ndarray]:
        return self.pointers.arrays() + self.values.arrays()

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> Ranges:
        return cls(EliasFano.of(arrays[: EliasFano.PARTS]), EliasFano.of(arrays[EliasFano.PARTS :]))

    def find(self, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each id among the successors of its context, or -1, and the place where those begin."""
        if not self.values.n or not len(context):
            return np.full(len(context), -1, np.int64), np.zeros(len(context), np.int64)
        lo, hi = self.pointers.access(context), self.pointers.access(context + 1)
        base = np.zeros(len(lo), np.int64)
        some = lo > 0
        base[some] = self.values.access(lo[some] - 1) + 1
        return self.values.find(lo, hi, np.where(ids < 0, -1, base + ids)), lo


def flatten(arrays: list[np.ndarray]) -> bytes:
    """One buffer: the number of arrays, their kinds and lengths, then their bytes at multiples of 8."""
    kinds = ["<i8", "<u8", "<u4", "|u1", "<f4"]
    head = [len(arrays)]
    for a in arrays:
        head += [kinds.index(a.dtype.newbyteorder("<").str), len(a)]
    parts = [np.array(head, "<i8").tobytes()]
    for a in arrays:
        parts += [a.tobytes(), b"\0" * (-a.nbytes % 8)]
    return b"".join(parts)


def unflatten(buffer: np.ndarray) -> list[np.ndarray]:
    """Views into a buffer of bytes made by flatten."""
    kinds = ["<i8", "<u8", "<u4", "|u1", "<f4"]
    n = int(buffer[:8].view("<i8")[0])
    head, at, out = buffer[8 : 8 + 16 * n].view("<i8"), 8 + 16 * n, []
    for kind, length in head.reshape(n, 2).tolist():
        size = length * np.dtype(kinds[kind]).itemsize
        out.append(buffer[at : at + size].view(kinds[kind]))
        at += size + -size % 8
    return out
