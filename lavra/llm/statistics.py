"""Statistics of whole texts, vectorised over slices of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from lavra.llm.shingles import mix
from lavra.llm.words import _SPACE, raw, slices, split_words, strings

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_top", "n_adjacent", "n_digits", "n_upper", "n_stops", "n_chars",
)
FEATURES = (
    "log_words", "mean_word", "symbols", "dup_lines", "repeats", "distinct",
    "top", "adjacent", "digits", "upper", "stops", "line_words", "surprise",
)

_table = {name: np.zeros(256, bool) for name in ("symbol", "digit", "upper", "stop", "start")}
_table["symbol"][list(b"#*$%&|<>")] = True
_table["digit"][48:58] = True
_table["upper"][65:91] = True
_table["stop"][list(b".,;:!?")] = True
_table["start"][:] = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def _per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return run[bounds[1:]] - run[bounds[:-1]]


def _repeats(codes: np.ndarray, bounds: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words per row inside 3-word windows that stand in the row twice or more."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n >= 3:
        whole = row[:-2] == row[2:]
        at = np.flatnonzero(whole)
        c = codes.astype(np.uint64)
        step = np.uint64(0x9E3779B97F4A7C15)
        h = ((row[at].astype(np.uint64) * step + c[at]) * step + c[at + 1]) * step + c[at + 2]
        h = mix(h)
        order = np.argsort(h, kind="stable")
        here, there = at[order[:-1]], at[order[1:]]
        equal = h[order[1:]] == h[order[:-1]]
        fits = row[here] == row[there]
        for k in range(3):
            fits &= codes[here + k] == codes[there + k]
        if np.any(equal & ~fits):  # two windows with one hash: sort by the words themselves
            order = np.lexsort((codes[at + 2], codes[at + 1], codes[at], row[at]))
            here, there = at[order[:-1]], at[order[1:]]
            equal = row[here] == row[there]
            for k in range(3):
                equal &= codes[here + k] == codes[there + k]
        twice = np.concatenate((here[equal], there[equal]))
        for k in range(3):
            covered[twice + k] = True
    return _per_row(covered, bounds)


def _lines(data: np.ndarray, bounds: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the lines with a word, and those among them that equal an earlier line."""
    breaks = np.flatnonzero(data == 10)
    # An empty last line and the next row begin at one place; only the row's line can hold a word.
    starts = np.unique(np.concatenate((bounds[:-1], breaks + 1)))
    starts = starts[starts < len(data)]
    before = np.searchsorted(breaks, starts)
    doc = np.searchsorted(bounds, starts, side="right") - 1
    following = np.append(breaks, len(data))[before]
    ends = np.minimum(following, bounds[doc + 1])
    inked = np.concatenate(([0], np.cumsum(~_SPACE[data])))
    worded = inked[ends] > inked[starts]
    codes = strings(data[data != 10], starts - before).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    doc, codes = doc[worded], codes[worded].astype(np.int64)
    n = np.bincount(doc, minlength=rows)
    distinct = np.unique(doc * (len(starts) + 1) + codes)
    return n, n - np.bincount(distinct // (len(starts) + 1), minlength=rows)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The ``COUNTS`` of every row, and the word entropy ``surprise`` in bits; null texts are empty."""
    data, bounds = raw(texts)
    words = split_words(texts)
    rows = len(texts)
    out = {"n_words": np.diff(words.bounds)}
    out["word_chars"] = _per_row(~_SPACE[data] & _table["start"][data], bounds)
    out["n_chars"] = _per_row(_table["start"][data], bounds)
    for name, kind in (("n_symbols", "symbol"), ("n_digits", "digit"), ("n_upper", "upper"), ("n_stops", "stop")):
        out[name] = _per_row(_table[kind][data], bounds)
    row = np.repeat(np.arange(rows), out["n_words"])
    width = len(words.distinct) + 1
    pairs, times = np.unique(row * width + words.codes, return_counts=True)
    owner = pairs // width
    out["n_distinct"] = np.bincount(owner, minlength=rows)
    out["n_top"] = np.zeros(rows, np.int64)
    np.maximum.at(out["n_top"], owner, times)
    total = np.maximum(out["n_words"], 1)
    out["surprise"] = np.log2(total) - np.bincount(owner, weights=times * np.log2(times), minlength=rows) / total
    same = np.zeros(len(row), bool)
    same[1:] = (words.codes[1:] == words.codes[:-1]) & (row[1:] == row[:-1])
    out["n_adjacent"] = _per_row(same, words.bounds)
    out["n_repeat_words"] = _repeats(words.codes, words.bounds, row)
    out["n_lines"], out["n_dup_lines"] = _lines(data, bounds, rows)
    return out


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The ``FEATURES`` as columns: shares and ratios on scales that are roughly even."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    columns = [
        np.log1p(c["n_words"]),
        np.log1p(c["word_chars"] / words),
        np.log1p(100 * c["n_symbols"] / chars),
        np.sqrt(c["n_dup_lines"] / np.maximum(c["n_lines"], 1)),
        np.sqrt(c["n_repeat_words"] / words),
        np.sqrt(c["n_distinct"] / words),
        np.sqrt(c["n_top"] / words),
        np.sqrt(c["n_adjacent"] / words),
        np.log1p(100 * c["n_digits"] / chars),
        np.log1p(100 * c["n_upper"] / chars),
        np.log1p(100 * c["n_stops"] / chars),
        np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)),
        c["surprise"] / np.maximum(np.log2(words), 1),
    ]
    return np.column_stack(columns).astype(float)


def _measure(texts: pa.Array) -> pa.Array:
    parts, rows = [], []
    for a, b in slices(texts):
        c = counts(texts.slice(a, b - a))
        parts.append(c)
        rows.append(features(c))
    columns = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for c in COUNTS]
    flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
    edges = pa.array(np.arange(0, len(flat) + 1, len(FEATURES)), pa.int32())
    columns.append(pa.ListArray.from_arrays(edges, pa.array(flat)))
    return pa.StructArray.from_arrays(columns, [*COUNTS, "features"])


def measured(text) -> Column:
    """A struct of the ``COUNTS`` and the array ``features`` of a text column."""
    kind = f"struct<{', '.join(f'{c}: long' for c in COUNTS)}, features: array<double>>"
    return F.arrow_udf(_measure, kind)(F.coalesce(F.col(text).cast("string"), F.lit("")))
