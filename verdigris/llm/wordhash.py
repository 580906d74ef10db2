"""Words of a batch of texts and their hashes, computed on whole numpy arrays.

A word's hash is a polynomial of its bytes modulo 2**64 (prefix sums over the
buffer, taken back to the word's start with the inverse power), then mixed; an
n-gram's hash is a polynomial of its words' hashes, then mixed.  All constants
are fixed, so every task and every run computes the same values.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Bytes hashed at a time, and bytes of text whose words are taken at a time.
_SLICE, TEXT_SLICE = 1 << 18, 2 << 20
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64

#: ASCII white space (blank, tab to carriage return) separates words.
WHITE_SEPARATED = np.array([b != 0x20 and not 9 <= b <= 13 for b in range(256)])
#: ASCII letters, digits and everything beyond ASCII make words.
ALPHANUMERIC = np.array([48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 for b in range(256)])


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + U((_STEP * (seed + 1)) % 2**64)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(256, dtype=U), 7)
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base % 2**64, dtype=U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(pow(_BASE, -1, 2**64))


class Hasher:
    """Keeps the tables of powers; one for each task."""

    def __init__(self):
        self.up, self.down = _powers(2 * _SLICE)

    def hash_spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        out = np.empty(len(starts), dtype=U)
        values, i = _VALUES[lower], 0
        while i < len(starts):
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + _SLICE, side="right")))
            hi = int(ends[j - 1])
            if hi - lo > len(self.up):
                self.up, self.down = _powers(hi - lo)
            sums = np.zeros(hi - lo + 1, dtype=U)
            np.cumsum(values[buf[lo:hi]] * self.up[:hi - lo], out=sums[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (sums[b] - sums[a]) * self.down[a]
            i = j
        return mix(out + (ends - starts).astype(U) * U(0xA24BAED4963EE407))

    def words(self, buf: np.ndarray, offs: np.ndarray, kind: np.ndarray = WHITE_SEPARATED, lower: bool = False) -> Words:
        starts, ends = spans(buf, offs, kind)
        return Words(starts, ends, np.searchsorted(starts, offs), self.hash_spans(buf, starts, ends, lower))


def spans(buf: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; no word goes over a row's end."""
    inside = np.zeros(len(buf) + 1, dtype=bool)
    inside[:-1] = kind[buf]
    begin, stop = inside[:-1].copy(), inside[:-1].copy()
    begin[1:] &= ~inside[:-2]
    stop &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    at, last = offs[:-1][full], offs[1:][full] - 1
    begin[at], stop[last] = inside[at], inside[last]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


class Words:
    """Words of some rows: byte spans, hashes, and ``first`` with the n + 1
    offsets of the rows among the words."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray):
        self.starts, self.ends, self.first, self.hash = starts, ends, first, hashes
        self.counts = np.diff(first)

    def row_ends(self) -> np.ndarray:
        """For each word the offset at which its row's words end."""
        return np.repeat(self.first[1:], self.counts)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the k-grams that start at each word (over row ends too)."""
    if len(hashes) < k:
        return np.zeros(0, dtype=U)
    n, base = len(hashes) - k + 1, U((_BASE * (2 * seed + 3)) % 2**64 | 1)
    out = hashes[:n].copy()
    for t in range(1, k):
        out *= base
        out += hashes[t:n + t]
    return mix(out, seed + k)


def gram_at(hashes: np.ndarray, at: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """``grams`` at some starts only."""
    base = U((_BASE * (2 * seed + 3)) % 2**64 | 1)
    out = hashes[at].copy()
    for t in range(1, k):
        out *= base
        out += hashes[at + t]
    return mix(out, seed + k)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    if len(x) < width:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x
