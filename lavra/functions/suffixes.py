"""Suffixes of words and sums over their shared prefixes: the in-task helper of the seed pieces.

In sorted suffixes all that begin with one string lie together, and the length that a suffix shares with
the one before it tells which strings end there and which begin. So one pass over sorted suffixes gives
the total of every substring, and a substring is written once, not once for every place it stands at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 16


def suffixes(words: pa.Array, counts: np.ndarray, shortest: int, longest: int) -> Iterator[pa.Table]:
    """``(suffix, uses)``: from each place of each word the next ``longest`` characters, with the word's count.

    Places with fewer than ``shortest`` characters left are skipped. Equal ones of a block are added up.
    """
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    if data is None or len(words) == 0:
        return
    bounds = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)[: bounds[-1]]
    heads = np.append(np.flatnonzero((data[bounds[0] :] & 0xC0) != 0x80) + bounds[0], bounds[-1])  # first bytes of characters
    ends = np.searchsorted(heads, bounds)  # words' bounds, in characters
    sizes = np.diff(ends)
    for first in range(0, len(heads) - 1, BLOCK):
        at = np.arange(first, min(first + BLOCK, len(heads) - 1))
        word = np.searchsorted(ends, at, side="right") - 1
        stop = np.minimum(at + longest, ends[word] + sizes[word])
        kept = stop - at >= shortest
        at, stop, word = at[kept], stop[kept], word[kept]
        if not len(at):
            continue
        width = heads[stop] - heads[at]
        bytes_ = np.concatenate([[0], np.cumsum(width)])
        taken = data[np.repeat(heads[at] - bytes_[:-1], width) + np.arange(bytes_[-1])]
        strings = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(bytes_), pa.py_buffer(taken)])
        block = pa.table({"suffix": strings.cast(pa.string()), "uses": counts[word]})
        summed = block.group_by("suffix").aggregate([("uses", "sum")])
        yield summed.select(["suffix", "uses_sum"]).rename_columns(["suffix", "uses"])


class PrefixSums:
    """Totals of the prefixes of sorted suffixes that come in batches.

    A call returns the prefixes that ended inside the batch; ``rest`` those still open. The first and last
    ones of each length may go on in another task and are marked as edges.
    """

    def __init__(self, shortest: int, longest: int):
        self.shortest, self.longest = shortest, longest
        self.open: dict[int, list] = {}  # by length: prefix, total, whether it is the task's first
        self.last: tuple[np.ndarray, int] | None = None

    def _shared(self, suffixes: pa.Array, sizes: np.ndarray) -> np.ndarray:
        """Characters that each suffix shares with the one before it."""
        chars = np.array(suffixes.to_pylist(), dtype=f"<U{self.longest}").view(np.uint32).reshape(len(suffixes), self.longest)
        before = np.zeros(self.longest, np.uint32) if self.last is None else self.last[0]
        ahead = np.concatenate([[0 if self.last is None else self.last[1]], sizes[:-1]])
        same = chars == np.concatenate([before[None, :], chars[:-1]])
        shared = np.where(same.all(axis=1), self.longest, same.argmin(axis=1))
        self.last = chars[-1].copy(), int(sizes[-1])
        return np.minimum(shared, np.minimum(sizes, ahead))

    def __call__(self, suffixes: pa.Array, uses: np.ndarray) -> list[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """``(prefixes, totals, edges)`` by length."""
        sizes = pc.utf8_length(suffixes).to_numpy(zero_copy_only=False).astype(np.int64)
        first_of_task = self.last is None
        shared = self._shared(suffixes, sizes)
        out = []
        for k in range(self.shortest, self.longest + 1):
            rows = np.flatnonzero(sizes >= k)
            if not len(rows):
                continue
            begins = np.flatnonzero(shared[rows] < k)
            added = uses[rows]
            head = added[: begins[0]].sum() if len(begins) else added.sum()
            if k in self.open:
                self.open[k][1] += int(head)
            if not len(begins):
                continue
            totals = np.add.reduceat(added[begins[0] :], begins - begins[0])
            prefixes = pc.utf8_slice_codeunits(suffixes.take(pa.array(rows[begins])), 0, k)
            edges = np.zeros(len(begins), bool)
            edges[0] = first_of_task and rows[begins[0]] == 0
            if k in self.open:
                prefix, total, edge = self.open[k]
                prefixes = pa.concat_arrays([pa.array([prefix], prefixes.type), prefixes])
                totals, edges = np.concatenate([[total], totals]), np.concatenate([[edge], edges])
            self.open[k] = [prefixes[-1].as_py(), int(totals[-1]), bool(edges[-1])]
            out.append((prefixes[:-1], totals[:-1], edges[:-1]))
        return out

    def rest(self) -> list[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """The open prefixes, as edges."""
        if not self.open:
            return []
        return [(pa.array([x[0] for x in self.open.values()], pa.string()), np.array([x[1] for x in self.open.values()]), np.ones(len(self.open), bool))]


class Best:
    """Of ``(prefixes, totals)`` those whose total times length is among the ``limit`` largest, ties kept.

    What can't be among them is dropped as it comes; an eighth beyond the limit, or 100,000, wait for the next cut.
    """

    def __init__(self, limit: int):
        self.limit, self.held, self.size, self.floor = limit, [], 0, 0
        self.room = limit + max(limit // 8, 100_000)

    def add(self, prefixes: pa.Array, totals: np.ndarray) -> None:
        if self.floor:
            kept = np.flatnonzero(_weights(prefixes, totals) >= self.floor)
            if len(kept) < len(totals):
                prefixes, totals = prefixes.take(pa.array(kept)), totals[kept]
        self.held.append((prefixes, totals))
        self.size += len(totals)
        if self.size > self.room:
            self.held = [self.taken()]
            self.size = len(self.held[0][1])
            self.room = max(self.room, self.size + 100_000)  # ties may fill it
            pa.default_memory_pool().release_unused()

    def taken(self) -> tuple[pa.Array, np.ndarray]:
        if not self.held:
            return pa.array([], pa.string()), np.zeros(0, np.int64)
        prefixes = pa.concat_arrays([p for p, _ in self.held])
        totals = np.concatenate([t for _, t in self.held])
        if len(totals) <= self.limit:
            return prefixes, totals
        weight = _weights(prefixes, totals)
        self.floor = np.partition(weight, len(weight) - self.limit)[len(weight) - self.limit]
        kept = np.flatnonzero(weight >= self.floor)
        return prefixes.take(pa.array(kept)), totals[kept]


def _weights(prefixes: pa.Array, totals: np.ndarray) -> np.ndarray:
    return totals * pc.utf8_length(prefixes).to_numpy(zero_copy_only=False)
