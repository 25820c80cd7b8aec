"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from lavra.llm.words import split_words

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _folded(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, one per start."""
    n = len(words) - length + 1
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = h * _STEP + words[k : k + n]
    return mix(h)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """For every row its distinct shingles, ascending; a text with fewer words is one shingle, an empty one none."""
    words = split_words(texts, fold=True)
    known = (xxhash.xxh3_64_intdigest(w) for w in words.distinct.to_pylist())
    hashes = np.fromiter(known, np.uint64, len(words.distinct))[words.codes]
    runs = _folded(hashes, size).view(np.int64) if len(hashes) >= size else np.zeros(0, np.int64)
    sets = []
    for start, stop in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if stop - start >= size:
            sets.append(np.unique(runs[start : stop - size + 1]))
        elif stop > start:
            sets.append(_folded(hashes[start:stop], stop - start).view(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets
