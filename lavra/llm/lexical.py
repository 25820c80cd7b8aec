"""Ranked search of a whole corpus for a set of items, without an index of the documents.

An automaton of all terms of the items, each with a guard on both sides so that only whole terms match,
goes to the tasks and reads every text once; its outputs number the terms, and terms map to items. That
scan is stored as one row per document: its length in terms and the frequencies of the terms found.
Corpus counts come from it, and a second pass over it scores, keeping the best rows of every item in each
task. Items travel in blocks of bounded size, one scan per block.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lavra.llm.words import raw, slices
from lavra.session import stage

BEST = 20
# Bounds of a block: characters of its distinct terms, and pairs of item and term.
BLOCK_CHARS = 1 << 21
BLOCK_PAIRS = 1 << 21
SCAN_BYTES = 4 << 20
SCORE_CELLS = 1 << 21

# 100 times one minus b, 100 times b, and 10 times k1 of the weighting.
BASE, SHARE, SATURATION = 75, 25, 12

# Digits and letters, A-Z as a-z, and all bytes beyond ASCII stand for themselves; the rest separates.
_TERM = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _TERM[_low:_high] = np.arange(_low, _high)
_TERM[65:91] = np.arange(97, 123)
_TERM_BYTES = _TERM.tobytes()

_COUNTED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
_BEST = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, as bytes."""
    return (text or "").encode().translate(_TERM_BYTES).split()


class _Block:
    """Items of one scan: ``items`` holds (number, id), ``known`` the distinct terms, ``pairs`` (term, item, repeats)."""

    def __init__(self):
        self.items: list[tuple[int, int | None]] = []
        self.known: dict[bytes, int] = {}
        self.pairs: list[tuple[int, int, int]] = []
        self.chars = 0

    def add(self, number: int, item_id: int | None, counted: Counter) -> None:
        for term, k in counted.items():
            if term not in self.known:
                self.known[term] = len(self.known)
                self.chars += len(term)
            self.pairs.append((self.known[term], len(self.items), k))
        self.items.append((number, item_id))

    def full(self) -> bool:
        return self.chars > BLOCK_CHARS or len(self.pairs) > BLOCK_PAIRS


def _blocks(items: DataFrame) -> Iterator[_Block]:
    block = _Block()
    for number, (item_id, text) in enumerate(items.toLocalIterator()):
        block.add(number, item_id, Counter(terms(text)))
        if block.full():
            yield block
            block = _Block()
    if block.items:
        yield block


def automaton(known: list[bytes]) -> ahocorasick.Automaton:
    """Finds the numbers of terms that stand between guards; one character is one byte."""
    found = ahocorasick.Automaton()
    for number, term in enumerate(known):
        found.add_word(f" {term.decode('latin-1')} ", number)
    if known:
        found.make_automaton()
    return found


def _stretches(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of stretches that begin and end with a guard; a guard between two belongs to both."""
    guards = np.flatnonzero(data == 32)
    at = 0
    while at < len(data) - 1:
        stop = guards[np.searchsorted(guards, at + limit, side="right") - 1]
        if stop <= at:  # one term beyond the limit
            stop = guards[np.searchsorted(guards, at, side="right")]
        yield at, int(stop) + 1
        at = int(stop)


def count_terms(texts: pa.Array, find: ahocorasick.Automaton, known: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every text its length in terms; and over all texts (row, term, frequency), in order."""
    data, bounds = raw(texts)
    rows = len(texts)
    guarded = np.full(len(data) + rows + 1, 32, np.uint8)
    plain = _TERM[data]
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        guarded[a + i + 1 : b + i + 1] = plain[a:b]
    heads = bounds + np.arange(rows + 1)  # the guard before each text
    inside = guarded != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    n = np.diff(np.searchsorted(starts, heads))
    keys, counts = [], []
    for a, b in _stretches(guarded, SCAN_BYTES) if known else ():
        hits = np.fromiter(itertools.chain.from_iterable(find.iter(guarded[a:b].tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
        row = np.searchsorted(heads, hits[:, 0] + (a - 1), side="right") - 1
        key, count = np.unique(row * known + hits[:, 1], return_counts=True)
        keys.append(key)
        counts.append(count)
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    if len(keys) > 1:  # a text may lie in several stretches
        key, back = np.unique(key, return_inverse=True)
        count = np.bincount(back, count, len(key)).astype(np.int64)
    return n, key // max(known, 1), key % max(known, 1), count


_ready: dict[str, ahocorasick.Automaton] = {}


def _find(scan: str, known: list[bytes]) -> ahocorasick.Automaton:
    """The automaton of a scan, built once in each Python worker."""
    if scan not in _ready:
        _ready.clear()
        _ready[scan] = automaton(known)
    return _ready[scan]


def _scan(shared):
    scan = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = _find(scan, shared.value), len(shared.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for start, stop in slices(texts):
                n, row, term, tf = count_terms(texts.slice(start, stop - start), find, known)
                offsets = pa.array(np.searchsorted(row, np.arange(stop - start + 1)), pa.int32())
                lists = (pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (term, tf))
                yield pa.RecordBatch.from_arrays([ids.slice(start, stop - start), pa.array(n, pa.int64()), *lists], schema=_COUNTED)

    return run


def scores(n, row, term, tf, model) -> np.ndarray:
    """Integer scores of rows (first axis) against items; ``row`` ascending, ``n`` by row."""
    weight, first, item, repeats, items, documents, length, exact = model
    m = BASE + (SHARE * n * documents) // length
    value = weight[term] * ((1_000_000_000 * tf) // (1_000 * tf + SATURATION * m[row]))
    some = value > 0
    row, term, value = row[some], term[some], value[some]
    times = first[term + 1] - first[term]
    pair = np.repeat(first[term] - np.cumsum(times) + times, times) + np.arange(times.sum())
    cell = np.repeat(row, times) * items + item[pair]
    worth = np.repeat(value, times) * repeats[pair]
    if exact:  # sums stay below 2^53, where doubles are exact
        total = np.bincount(cell, worth, len(n) * items).astype(np.int64)
    else:
        total = np.zeros(len(n) * items, np.int64)
        np.add.at(total, cell, worth)
    return total.reshape(len(n), items)


def _rank(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, named = shared.value
        items = model[4]
        held = np.zeros((0, 4), np.int64)  # item, -score, key is null, key
        least = np.ones(items, np.int64)  # a lower score can't be among the best any more
        for batch in batches:
            lists = [batch.column(i) for i in (2, 3)]
            bounds = lists[0].offsets.to_numpy()
            flat_terms, flat_tfs = (x.values.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            n = batch.column(1).to_numpy()
            null = np.asarray(batch.column(0).is_null())
            key = batch.column(0).fill_null(0).to_numpy()
            step = max(1, SCORE_CELLS // items)
            for a in range(0, len(n), step):
                b = min(a + step, len(n))
                part = slice(bounds[a], bounds[b])
                row = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                score = scores(n[a:b], row, flat_terms[part], flat_tfs[part], model)
                reach = least
                if b - a > BEST:
                    reach = np.maximum(least, np.partition(score, b - a - BEST, axis=0)[b - a - BEST])
                r, i = np.nonzero(score >= reach)
                new = np.stack([i, -score[r, i], null[a + r], key[a + r]], axis=1)
                held = np.concatenate([held, new])
                held = held[np.lexsort(held.T[::-1])]
                begin = np.searchsorted(held[:, 0], np.arange(items + 1))
                held = held[np.arange(len(held)) - begin[held[:, 0]] < BEST]
                begin = np.searchsorted(held[:, 0], np.arange(items + 1))
                filled = np.flatnonzero(np.diff(begin) == BEST)
                least = np.ones(items, np.int64)
                least[filled] = -held[begin[filled + 1] - 1, 1]
        number, item_id = (pa.array([x[k] for x in named], pa.int64()) for k in (0, 1))
        at = pa.array(held[:, 0])
        key = pa.array(held[:, 3], pa.int64(), mask=held[:, 2] > 0)
        yield pa.RecordBatch.from_arrays([number.take(at), item_id.take(at), key, pa.array(-held[:, 1])], schema=_BEST)

    return run


def _search(docs: DataFrame, block: _Block) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    context = spark.sparkContext
    known = list(block.known)
    found = docs.mapInArrow(_scan(context.broadcast(known)), "doc_id long, n long, terms array<int>, tfs array<int>")
    counted = stage(found.where("n > 0"), "term-counts")
    documents, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = np.zeros(len(known), np.int64)
    for term, df in holding.collect():  # at most the terms of one block
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
    term, item, repeats = np.array(sorted(block.pairs), np.int64).reshape(-1, 3).T
    first = np.searchsorted(term, np.arange(len(known) + 1))
    largest = max(np.bincount(item, weight[term] * repeats, 1).max(initial=0), 1)
    model = (weight, first, item, repeats, len(block.items), documents, max(length, 1), largest * 1e6 < 2**53)
    return counted.mapInArrow(_rank(context.broadcast((model, block.items))), "item long, item_id long, doc_id long, score long")


def best_documents(
    docs: DataFrame, items: DataFrame, *, key="doc_id", text="text", item="item_id", item_text="text", best: int = BEST
) -> DataFrame:
    """For every item its best-scoring documents: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. Only scores above 0
    count; equal scores go by ascending key, null keys last, and a repeated row is found as often as it is
    there. Null texts and texts without terms are no documents; items without terms find nothing. An
    item that is there twice gets two rankings. Other columns are not read, so their names cannot clash.
    Empty tables give no rows.
    """
    if best > BEST:
        raise ValueError(f"at most {BEST} documents for each item")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    found = [_search(texts, block) for block in _blocks(asked)]
    out = found[0] if found else docs.sparkSession.createDataFrame([], "item long, item_id long, doc_id long, score long")
    for more in found[1:]:
        out = out.unionByName(more)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Each task sends its best rows only; parts by key keep the last step small when tasks are many.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    for keys in (("item", part), ("item",)):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    return out.select("item_id", "rank", "doc_id", "score")


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPLIT = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_PATTERN}')"
BEST_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ts FROM documents WHERE text IS NOT NULL),
t AS (SELECT r, doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM t),
o AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM t) GROUP BY ALL),
w AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM o GROUP BY term), s
),
q AS (
    SELECT i, item_id, term, count(*) AS k
    FROM (SELECT i, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_SPLIT} AS ts FROM benchmark WHERE text IS NOT NULL))
    GROUP BY ALL
),
c AS (
    SELECT i, item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total)))))::BIGINT AS score
    FROM o JOIN q USING (term) JOIN w USING (term), s GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM c WHERE score > 0
) WHERE rank <= 20
"""
