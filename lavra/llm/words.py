"""Words of Arrow text columns as numpy arrays.

A word is a run of characters other than space and U+0009 to U+000D. Batches are worked through in
slices of bounded bytes, so memory does not follow the batch size that a session happens to set; only a
single text beyond the bound makes a larger slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, or those of a large binary one, and the byte bounds of its rows;
    null rows are empty."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if big else np.int32
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Row ranges ``(start, stop)`` whose texts hold at most ``limit`` bytes, or one row."""
    _, bounds = raw(texts)
    start, n = 0, len(texts)
    while start < n:
        stop = int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


@dataclass
class Words:
    """``codes[bounds[i]:bounds[i + 1]]`` are the words of row i, as places in ``distinct``."""

    codes: np.ndarray
    bounds: np.ndarray
    distinct: pa.Array


def strings(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` as a string array."""
    ends = np.append(starts, len(data))
    big = len(data) >= 2**31 - 1
    kind = pa.large_string() if big else pa.string()
    offsets = ends.astype(np.int64 if big else np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind, len(starts), buffers)


def split_words(texts: pa.Array, *, fold: bool = False, stops: np.ndarray | None = None) -> Words:
    """Words of every row; with ``fold``, A-Z become a-z first.

    ``stops`` marks, of the 256 bytes, those that begin a new word after one of A-Z and a-z.
    """
    data, bounds = raw(texts)
    space = _SPACE[data]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    heads = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[heads] = inside[heads]
    if stops is not None:
        first[1:] |= stops[data[1:]] & _LETTER[data[:-1]]
    kept = data[inside]
    if fold:
        kept = _FOLD[kept]
    coded = strings(kept, np.flatnonzero(first[inside])).dictionary_encode()
    places = np.searchsorted(np.flatnonzero(first), bounds)
    return Words(coded.indices.to_numpy(zero_copy_only=False), places, coded.dictionary)
