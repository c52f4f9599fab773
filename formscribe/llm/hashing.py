"""Word and window hashes of many texts at once, as numpy arrays. All run inside tasks, a chunk of rows at a time."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Texts of about so many characters are worked on together; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 20

_ODD = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers of a seed."""
    with np.errstate(over="ignore"):
        start = np.uint64(seed % (1 << 32)) * np.uint64(0xA0761D6478BD642F)
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start)


@lru_cache(maxsize=8)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base % (1 << 64), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
    """Hash of values[lo:hi] for many spans at once, wherever they lie: prefix sums of value times odd power."""
    size = 1 << max(10, int(len(values) + 1).bit_length())
    base = _ODD[which]
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(size, base)[: len(values)], out=sums[1:])
    return (sums[hi] - sums[lo]) * _powers(size, pow(base, -1, 1 << 64))[lo]


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts that hold about `limit` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, one after another, and the number of words of each text.

    Words are what is left between blanks, tabs and line breaks; null and empty texts have none.
    """
    data = "\n".join([t or "" for t in texts]).encode("utf-8", "surrogatepass")
    buf = np.frombuffer(data, dtype=np.uint8)
    word = np.zeros(len(buf) + 2, dtype=np.int8)
    word[1:-1] = _IS_WORD[buf]
    edges = np.diff(word)
    lo, hi = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sizes = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    counts = np.diff(np.searchsorted(lo, ends), prepend=0)
    hashes = mix(span_hashes(randoms(1, 256)[buf], lo, hi, 0) + (hi - lo).astype(np.uint64))
    return hashes, counts


def window_hashes(hashes: np.ndarray, counts: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, one text after another, and the number of runs of each text."""
    runs = np.maximum(counts - k + 1, 0)
    first = np.repeat(np.cumsum(counts) - counts, runs)
    inside = np.arange(len(first)) - np.repeat(np.cumsum(runs) - runs, runs)
    lo = first + inside
    values = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) if which else hashes
    return mix(span_hashes(values, lo, lo + k, which) + np.uint64(k)), runs
