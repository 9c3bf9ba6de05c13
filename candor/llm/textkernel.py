"""Array kernels over UTF-8 bytes: words, their hashes and rolling shingles for many texts at once.

Texts are joined by line feeds into one byte array, so that every step is a handful of array
operations whatever the number of texts. A word's hash is a difference of prefix sums of
``byte * BASE**position`` modulo 2**64, scaled back by the inverse power and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that one round of array operations takes on; a longer text makes a round of its own.
CHUNK_BYTES = 1 << 19

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII other than digits and letters separates; every byte of a non-ASCII character is a word byte.
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, U)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column) -> list[bytes]:
    """The texts of an Arrow string array as UTF-8; null becomes empty."""
    return [t or b"" for t in column.cast("binary").to_pylist()]


class Words:
    """The words of several texts.

    raw: all bytes; starts, ends: each word's place in them; doc: each word's text;
    first: index of each text's first word, with the number of words at the end.
    """

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES, lower: bool = True):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.raw = LOWER[raw] if lower else raw
        gap = separators[raw]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_ends = np.cumsum(lengths + 1)
        self.text_lengths = lengths
        self.first = np.concatenate([[0], np.searchsorted(self.starts, self.text_ends)])
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        up, down = _power_table(len(self.raw))
        sums = np.empty(len(self.raw) + 1, U)
        sums[0] = 0
        np.cumsum((self.raw.astype(U) + U(1)) * up[: len(self.raw)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))


def shingles(words: Words, hashes: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of k words; a text of fewer words, but at least one, is one shingle."""
    n = len(hashes)
    counts = words.counts()
    mult = U(0xD6E8FEB86659FD93)
    whole = max(0, n - k + 1)
    rolled = np.zeros(whole, U)
    for j in range(k):
        rolled = rolled * mult + hashes[j : whole + j]
    inside = words.doc[: len(rolled)] == words.doc[k - 1 :] if len(rolled) else np.zeros(0, bool)
    doc, out = words.doc[: len(rolled)][inside], mix(rolled[inside])
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        more = []
        for d in short:
            h = U(counts[d])
            for x in hashes[words.first[d] : words.first[d + 1]]:
                with np.errstate(over="ignore"):
                    h = h * mult + x
            more.append(h)
        doc, out = np.concatenate([doc, short]), np.concatenate([out, mix(np.array(more, U))])
        order = np.argsort(doc, kind="stable")
        doc, out = doc[order], out[order]
    return doc, out


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, value, count) of each distinct pair, ordered by doc and value; doc comes in order."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))
