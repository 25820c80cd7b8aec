"""Segmentations of a batch of words with scored pieces: the small in-task helper of the unigram jobs.

A word's edges are its substrings up to the longest piece, by start and then length. Words of one length
share their edges, so each step runs over all of them at once.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LONG_WORD = 256
_BLOCK = 1 << 20
# Paths whose logarithm stays within this bound can be added up as plain doubles, which end at 709.
_PLAIN = 500.0


def edges_of(n: int, longest: int):
    """(start, end) of every edge of a word of ``n`` characters."""
    return ((s, e) for s in range(n) for e in range(s + 1, min(n, s + longest) + 1))


def edge_ends(n: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts and the ends of the edges, in the same order."""
    widths = np.minimum(longest, n - np.arange(n))
    starts = np.repeat(np.arange(n), widths)
    firsts = np.repeat(np.cumsum(widths) - widths, widths)
    return starts, starts + np.arange(len(starts)) - firsts + 1


def _spans(n: int, longest: int) -> list[tuple[int, int]]:
    """For each start the range of its edges."""
    stops = np.cumsum(np.minimum(longest, n - np.arange(n))).tolist()
    return list(zip([0, *stops], stops))


def by_length(sizes: np.ndarray):
    """Row numbers of each word length; empty words have no edges."""
    for n in np.unique(sizes):
        if n > 0:
            yield int(n), np.flatnonzero(sizes == n)


def _numbers(strings, known: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(strings, value_set=known), -1).to_numpy()


def edge_pieces(words: pa.Array, longest: int, known: pa.Array):
    """For each word length: its rows, and the piece number of each edge (edges x words), -1 for none.

    The substrings of the batch are looked up together, so the table of pieces is hashed once. Long words
    are cut one by one instead, in blocks, since few share a length.
    """
    groups, slices, long = [], [], []
    for n, rows in by_length(pc.utf8_length(words).to_numpy()):
        same = words.take(pa.array(rows))
        if n > _LONG_WORD:
            long.append((n, rows, same.to_pylist()))
            continue
        at = len(slices)
        slices.extend(pc.utf8_slice_codeunits(same, s, e) for s, e in edges_of(n, longest))
        groups.append((n, rows, len(slices) - at))
    if slices:
        found, at = _numbers(pa.chunked_array(slices), known), 0
        for n, rows, edges in groups:
            size = edges * len(rows)
            yield n, rows, found[at : at + size].reshape(edges, len(rows))
            at += size
    strings = (w[s:e] for n, _, same in long for w in same for s, e in edges_of(n, longest))
    blocks = iter(lambda: list(islice(strings, _BLOCK)), [])
    found = [_numbers(pa.array(block, pa.string()), known) for block in blocks]
    found, at = np.concatenate(found) if found else None, 0
    for n, rows, same in long:
        size = len(edge_ends(n, longest)[0]) * len(rows)
        yield n, rows, found[at : at + size].reshape(len(rows), -1).T
        at += size


def edge_scores(pieces: np.ndarray, n: int, longest: int, scores: np.ndarray, unknown: float):
    """Score of each edge; a character that is no piece still passes, at ``unknown``."""
    out = scores[pieces] if len(scores) else np.empty(pieces.shape)
    out[pieces < 0] = -np.inf
    starts, ends = edge_ends(n, longest)
    single = np.flatnonzero(ends - starts == 1)
    out[single] = np.where(np.isneginf(out[single]), unknown, out[single])
    return out


def expected_uses(edge: np.ndarray, n: int, longest: int) -> np.ndarray:
    """Expected use of each edge over all segmentations of its word (forward-backward)."""
    ahead = np.full((n + 1, edge.shape[1]), -np.inf)
    behind = ahead.copy()
    ahead[0] = behind[n] = 0.0
    spans = _spans(n, longest)
    for s, (a, b) in enumerate(spans):  # the edges of one start end at different places
        ends = slice(s + 1, s + 1 + b - a)
        ahead[ends] = np.logaddexp(ahead[ends], ahead[s] + edge[a:b])
    for s in range(n - 1, -1, -1):
        a, b = spans[s]
        behind[s] = np.logaddexp.reduce(behind[s + 1 : s + 1 + b - a][::-1] + edge[a:b][::-1], axis=0)
    starts, ends = edge_ends(n, longest)
    return np.exp(ahead[starts] + edge + behind[ends] - ahead[n])


def sums_are_plain(n: int, lowest: float) -> bool:
    """Whether ``plain_uses`` may take words of ``n`` characters whose edges score from ``lowest`` to 0."""
    return n <= _LONG_WORD and -n * lowest < 2 * _PLAIN


def plain_uses(pieces: np.ndarray, n: int, longest: int, weights: np.ndarray, lowest: float) -> np.ndarray:
    """The same for the pieces of the edges, without logarithms.

    ``weights`` are the exponentials of the scores, and one more of 0 for edges without a piece; ``lowest``
    is the score of an unknown character. Where a path might leave the range of a double, each
    character is given the same factor, which no expectation depends on.
    """
    weight = weights[pieces]
    starts, ends = edge_ends(n, longest)
    single = np.flatnonzero(ends - starts == 1)
    weight[single] = np.where(weight[single] == 0, np.exp(lowest), weight[single])
    if -n * lowest >= _PLAIN:
        weight *= np.exp(-lowest / 2 * (ends - starts))[:, None]
    ahead = np.zeros((n + 1, pieces.shape[1]))
    behind = ahead.copy()
    ahead[0] = behind[n] = 1.0
    spans = _spans(n, longest)
    for s, (a, b) in enumerate(spans):
        ahead[s + 1 : s + 1 + b - a] += ahead[s] * weight[a:b]
    for s in range(n - 1, -1, -1):
        a, b = spans[s]
        weight[a:b] *= behind[s + 1 : s + 1 + b - a]
        behind[s] = weight[a:b].sum(axis=0)
        weight[a:b] *= ahead[s] / ahead[n]
    return weight


def best_path(edge: np.ndarray, n: int, longest: int):
    """Score of each word's best segmentation, and its edges from the last to the first (-1 past it)."""
    words = edge.shape[1]
    best = np.full((n + 1, words), -np.inf)
    back = np.full((n + 1, words), -1)
    best[0] = 0.0
    for s, (a, b) in enumerate(_spans(n, longest)):
        ends = slice(s + 1, s + 1 + b - a)
        score = best[s] + edge[a:b]
        better = score > best[ends]
        np.copyto(best[ends], score, where=better)
        np.copyto(back[ends], np.arange(a, b)[:, None], where=better)
    starts, _ = edge_ends(n, longest)
    here, column, path = np.full(words, n), np.arange(words), []
    while (here > 0).any():
        taken = np.where(here > 0, back[here, column], -1)
        path.append(taken)
        here = np.where(taken >= 0, starts[taken], 0)
    return best[n], np.array(path)


def segmented(words: pa.Array, known: pa.Array, scores: np.ndarray, longest: int, unknown: float) -> pa.ListArray:
    """Piece numbers of each word's best segmentation; a run of unknown characters is one -1."""
    sizes, groups = np.zeros(len(words), np.int64), []
    for n, rows, pieces in edge_pieces(words, longest, known):
        _, path = best_path(edge_scores(pieces, n, longest, scores, unknown), n, longest)
        path = path[::-1].T  # words x edges, from the first to the last, -1 before the first
        taken = path >= 0
        piece = pieces[np.where(taken, path, 0), np.arange(len(rows))[:, None]]
        again = taken[:, :-1] & (piece[:, :-1] < 0) & (piece[:, 1:] < 0)
        taken[:, 1:] &= ~again
        sizes[rows] = taken.sum(axis=1)
        groups.append((rows, piece[taken]))
    stops = np.cumsum(sizes)
    flat = np.empty(stops[-1] if len(stops) else 0, np.int32)
    for rows, pieces in groups:  # the places of a word's pieces follow each other
        count = sizes[rows]
        first = np.repeat(stops[rows] - np.cumsum(count), count)
        flat[first + np.arange(len(pieces))] = pieces
    starts = np.concatenate([[0], stops]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))


def segment(words: pa.Array, known: pa.Array, scores: np.ndarray, longest: int, unknown: float) -> list[list[int]]:
    """The same as lists."""
    return segmented(words, known, scores, longest, unknown).to_pylist()
