"""Arithmetic on symbol sequences that the repeated-passage operators share.

A *window* is ``W`` consecutive symbols of one document. Its *anchor* is the
position, among those of its k-grams, with the smallest hash (leftmost on ties).
Equal windows have equal anchors at equal places, and an anchor serves a run of
consecutive windows, its *span*; so a window can repeat only if its anchor's
k-gram does.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept between calls."""
    if len(_powers[0]) < n:
        for i, base in enumerate((ODD, INV)):
            p = np.full(n, base)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[i] = p
    return _powers[0][:n], _powers[1][:n]


class Hashes:
    """Hashes of any stretch of values, from prefix sums."""

    def __init__(self, x: np.ndarray):
        p, self.inverse = powers(len(x) + 1)
        self.total = np.empty(len(x) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(x * p[:-1], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.total[ends] - self.total[starts]) * self.inverse[starts]

    def grams(self, width: int) -> np.ndarray:
        n = len(self.total) - width
        return (self.total[width:] - self.total[:n]) * self.inverse[:n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, length = x, 1
    while 2 * length <= width:
        out, length = np.minimum(out[: len(out) - length], out[length:]), 2 * length
    if length < width:
        m = len(x) - width + 1
        out = np.minimum(out[:m], out[width - length : width - length + m])
    return out


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of bytes; words are runs without ASCII white space."""
    solid = ~WHITE[data]
    edge = np.diff(np.concatenate(([False], solid, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    return mix(Hashes(BYTES[data]).of(starts, ends) + (ends - starts).astype(np.uint64))


def spans(x: np.ndarray, sizes: np.ndarray, window: int, k: int):
    """Spans of documents laid end to end: ``(hash, digest, document, low, high)``, places relative to the document.

    ``low`` to ``high`` are the first and the last start of the windows with that
    anchor; ``digest`` is of all symbols that these windows cover and of the anchor's place.
    """
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    if len(x) < window:
        return none
    ends = np.cumsum(sizes)
    hashes = Hashes(x)
    grams = mix(hashes.grams(k))
    left = np.repeat(ends, sizes) - np.arange(len(x))  # symbols from here to the document's end
    key = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    low = sliding_min(key, window - k + 1)
    at = (low & U(0xFFFFFFFF)).astype(np.int64)
    valid = left[: len(at)] >= window
    turn = at[1:] != at[:-1]
    first = np.flatnonzero(valid & np.concatenate(([True], turn | ~valid[:-1])))
    if not len(first):
        return none
    last = np.flatnonzero(valid & np.concatenate((turn | ~valid[1:], [True])))
    base = (ends - sizes)[(doc := np.searchsorted(ends, first, side="right"))]
    anchor = at[first]
    digest = mix(hashes.of(first, last + window) + mix((anchor - first).astype(np.uint64) * U(1 << 20) + (last - first).astype(np.uint64)))
    return grams[anchor], digest, doc, first - base, last - base
