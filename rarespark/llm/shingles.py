"""Word shingles and MinHash signatures inside tasks (numpy on Arrow batches)."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
BANDS, BAND_ROWS = 40, 4
HASHES = BANDS * BAND_ROWS

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_IN_WORD = bytes(b not in b"\t\n\v\f\r " for b in range(256))
_LANES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, np.uint64(base & 0xFFFFFFFFFFFFFFFF))
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each word: a run of bytes other than ASCII white space.

    The hash sums mixed lanes of eight bytes by their place in the word, and is mixed with
    the word's length: work goes by words, not by bytes."""
    inside = np.frombuffer(b"\0" + data.translate(_IN_WORD) + b"\0", bool)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    sums = mix64(eights[starts] & _LANES[np.minimum(sizes, 8)])
    long = np.flatnonzero(sizes > 8)
    if len(long):
        more = (sizes[long] - 1) >> 3
        begins = np.cumsum(more) - more
        own = np.repeat(long, more)
        lane = np.arange(1, len(own) + 1) - np.repeat(begins, more)
        parts = eights[starts[own] + 8 * lane] & _LANES[np.minimum(sizes[own] - 8 * lane, 8)]
        sums[long] += np.add.reduceat(mix64(parts + lane.astype(np.uint64) * np.uint64(_BASE)), begins)
    return starts, mix64(sums + sizes.astype(np.uint64))


def lowered(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()


def chained(h: np.ndarray, count: int, n: int) -> np.ndarray:
    """Hashes of the ``n`` runs of ``count`` words that begin at words 0..n-1."""
    sums = h[:n] + np.uint64(count)
    for i in range(1, count):
        sums *= np.uint64(_BASE)
        sums += h[i : n + i]
    return mix64(sums)


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; of the whole sequence if
    there are fewer words; empty without words."""
    _, h = word_hashes(lowered(text))
    if not len(h):
        return h
    count = min(SHINGLE, len(h))
    return np.unique(chained(h, count, len(h) - count + 1))


_random = np.random.RandomState(20240229)
_MULTIPLY = (_random.randint(0, 1 << 62, HASHES).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _random.randint(0, 1 << 62, HASHES).astype(np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """``HASHES`` minima of multiply-add functions of the set."""
    low = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 2048):
        some = hashes[at : at + 2048, None] * _MULTIPLY + _ADD
        np.minimum(low, some.min(axis=0), out=low)
    return low


def jaccard_parts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(intersection, union) of two sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
