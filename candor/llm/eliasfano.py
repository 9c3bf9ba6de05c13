"""Elias-Fano sequences over numpy buffers: n non-decreasing integers in about 2 + log2(max / n) bits each.

The low bits of every number are packed side by side; the high bits are written in unary, number i
as a one at bit ``high + i``. All look-ups take arrays of positions or values.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Positions of a range that are read one after the other.
SHORT = 3

#: At 8 * byte + k the place of the byte's k-th one.
_NTH = np.zeros(256 * 8, np.uint8)
for _b in range(256):
    for _k, _at in enumerate(i for i in range(8) if _b >> i & 1):
        _NTH[8 * _b + _k] = _at
#: Every second bit, pair and half byte, each byte's lowest and highest bit.
_ODD, _TWOS, _FOURS, _EACH, _TOPS = (U(0x0101010101010101 * b) for b in (0x55, 0x33, 0x0F, 0x01, 0x80))


def build(values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a sequence: meta (n, width of low bits), low, high, and the ones and zeros before each word of high."""
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // max(1, n)).bit_length() - 1)
    bits = np.arange(n, dtype=U) * U(width)
    low = np.zeros(n * width // 64 + 2, U)
    if width:
        part = values & U((1 << width) - 1)
        word, offset = (bits >> U(6)).astype(np.int64), bits & U(63)
        np.bitwise_or.at(low, word, part << offset)
        over = offset + U(width) > U(64)
        np.bitwise_or.at(low, word[over] + 1, part[over] >> (U(64) - offset[over]))
    place = (values >> U(width)).astype(np.int64) + np.arange(n)
    words = (int(place[-1]) if n else 0) // 64 + 2
    flags = np.zeros(words * 64, np.uint8)
    flags[place] = 1
    high = np.packbits(flags, bitorder="little").view(U)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
    zeros = np.arange(len(ones)) * 64 - ones
    kind = np.uint32 if words < 1 << 26 else np.int64
    return {"meta": np.array([n, width], np.int64), "low": low, "high": high, "ones": ones.astype(kind), "zeros": zeros.astype(kind)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = map(int, arrays["meta"])
        self.low_words, self.high, self.ones, self.zeros = arrays["low"], arrays["high"], arrays["ones"], arrays["zeros"]
        # the eight bytes from each byte on: low bits of up to 57 lie in one of them
        self.low_bytes = np.ndarray(len(self.low_words) * 8 - 7, U, self.low_words, strides=(1,))

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        bit = i * self.width
        if self.width <= 57:
            out = self.low_bytes[bit >> 3]
            out >>= (bit & 7).astype(U)
            out &= U((1 << self.width) - 1)
            return out
        word, offset = bit >> 6, (bit & 63).astype(U)
        out = self.low_words[word] >> offset
        spill = offset > U(64 - self.width)
        out[spill] |= self.low_words[word[spill] + 1] << (U(64) - offset[spill])
        return out & U((1 << self.width) - 1)

    def _select(self, k: np.ndarray, ranks: np.ndarray, flip: bool) -> np.ndarray:
        """Bit of the k-th (from 0) one, or zero if flip."""
        word = np.searchsorted(ranks, k.astype(ranks.dtype), "right") - 1
        left = (k - ranks[word]).astype(U)
        rest = self.high[word]
        if flip:
            np.invert(rest, out=rest)
        # ones in the bytes up to each byte, side by side
        sums = rest >> U(1)
        sums &= _ODD
        np.subtract(rest, sums, out=sums)
        pairs = sums >> U(2)
        pairs &= _TWOS
        sums &= _TWOS
        sums += pairs
        sums += sums >> U(4)
        sums &= _FOURS
        sums *= _EACH
        # the byte is the first one with more than left: those before it keep their top bit
        before = left * _EACH
        before |= _TOPS
        before -= sums
        before &= _TOPS
        shift = np.bitwise_count(before).astype(U)
        shift <<= U(3)
        sums <<= U(8)
        sums >>= shift
        sums &= U(255)
        left -= sums
        rest >>= shift
        rest &= U(255)
        rest <<= U(3)
        rest |= left
        word <<= 6
        word += shift.view(np.int64)
        word += _NTH[rest.view(np.int64)]
        return word

    def get(self, i: np.ndarray) -> np.ndarray:
        """Numbers at positions i, 0 <= i < n."""
        if not len(i):
            return np.zeros(0, U)
        high = self._select(i, self.ones, False) - i
        return high.astype(U) << U(self.width) | self.low(i)

    def _next(self, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The bit of number i + 1, given that of number i; mostly in the same word."""
        rest = (self.high[bit >> 6] >> (bit & 63).astype(U)) >> U(1)
        after = bit + 1 + np.bitwise_count((rest & (~rest + U(1))) - U(1))
        far = np.flatnonzero(rest == 0)
        after[far] = self._select(i[far] + 1, self.ones, False)
        return after

    def ranges(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers at positions i and i + 1."""
        if not len(i):
            return np.zeros(0, U), np.zeros(0, U)
        bit = self._select(i, self.ones, False)
        after = self._next(bit, i)
        width = U(self.width)
        return (bit - i).astype(U) << width | self.low(i), (after - i - 1).astype(U) << width | self.low(i + 1)

    def find_after(self, x: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of x plus the number before the range, -1 where it is not there, among positions first[at] <= i < end[at].

        The number before a range that starts the sequence is 0; numbers of a range differ. Short ranges
        are read on from the number before them, of others the run of the wanted high bits is searched.
        """
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        later = first > 0
        bit = np.full(len(first), -1, np.int64)
        bit[later] = self._select(first[later] - 1, self.ones, False)
        base = np.zeros(len(first), U)
        base[later] = (bit[later] - first[later] + 1).astype(U) << U(self.width) | self.low(first[later] - 1)
        size = (end - first)[at]
        wanted = base[at] + x
        wide = np.flatnonzero(size > SHORT)
        if len(wide):
            of = at[wide]
            out[wide] = self._in_runs(wanted[wide], first[of], end[of])
        live = np.flatnonzero((size > 0) & (size <= SHORT))
        if len(live):
            of = at[live]
            place, last, bits, wanted = first[of], end[of], bit[of], wanted[live]
            start = np.flatnonzero(place == 0)
            while True:
                on = self._next(np.maximum(bits, 0), place - 1)
                on[start] = self._select(place[start], self.ones, False)
                value = (on - place).astype(U) << U(self.width) | self.low(place)
                here = value == wanted
                out[live[here]] = place[here]
                go = np.flatnonzero((value < wanted) & (place + 1 < last))
                if not len(go):
                    break
                live, place, last, bits, wanted, start = live[go], place[go] + 1, last[go], on[go], wanted[go], np.zeros(0, np.int64)
        return out

    def _runs(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the positions of numbers with these high bits.

        A zero ends each run of equal high bits, so it lies between the zero before it and its own.
        """
        first = np.zeros(len(high), np.int64)
        later = np.flatnonzero(high > 0)
        first[later] = self._select(high[later] - 1, self.zeros, True) + 1
        # most runs are short and end in the same word
        word = ~self.high[first >> 6] >> (first & 63).astype(U)
        length = np.bitwise_count((word & (~word + U(1))) - U(1)).astype(np.int64)
        long = np.flatnonzero(word == 0)
        length[long] = self._select(high[long], self.zeros, True) - first[long]
        first -= high
        return first, first + length

    def _successors(self, low: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first position from at on, in a run of equal high bits, whose low bits are not less; end if there is none. By halving."""
        out = at.copy()
        live = np.flatnonzero(at < end)
        at, end, low = at[live], end[live], low[live]
        going = np.ones(len(live), bool)
        while len(live):
            middle = (at + end) >> 1
            small = (self.low(middle) < low) & going
            at, end = np.where(small, middle + 1, at), np.where(small, end, middle)
            going = at < end
            left = np.flatnonzero(going)
            if 4 * len(left) < 3 * len(live):
                out[live] = at
                live, at, end, low, going = live[left], at[left], end[left], low[left], going[left]
        return out

    def _in_runs(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each x among positions first <= i < end, -1 where it is not there."""
        out = np.full(len(x), -1, np.int64)
        high = (x >> U(self.width)).astype(np.int64)
        inside = np.flatnonzero(high < self.zeros[-1])
        low = x[inside] & U((1 << self.width) - 1)
        lo, hi = self._runs(high[inside])
        # the range before may end with x
        lo, hi = np.maximum(lo, first[inside]), np.minimum(hi, end[inside])
        at = self._successors(low, lo, hi)
        some = np.flatnonzero(at < hi)
        some = some[self.low(at[some]) == low[some]]
        out[inside[some]] = at[some]
        return out

    def find_between(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each x among positions first <= i < end, -1 where it is not there."""
        return self._in_runs(x, first, end) if self.n else np.full(len(x), -1, np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The position of the successor of each x, the first number not less; n if there is none."""
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64)
        out = np.full(len(x), self.n, np.int64)
        high = (x >> U(self.width)).astype(np.int64)
        inside = np.flatnonzero(high < self.zeros[-1])
        lo, hi = self._runs(high[inside])
        out[inside] = self._successors(x[inside] & U((1 << self.width) - 1), lo, hi)
        return np.minimum(out, self.n)
