"""Token pieces and best-two-fit packing into sequences of a fixed size.

Packing needs only how many pieces there are of each length, at most ``size`` counts. From them the driver
plans which lengths share a sequence and how often that pattern repeats; the plan has a few thousand rows
at any input size. Every piece then finds its place from its rank among the pieces of its length, so no
group is ever gathered and no text moves.
"""

from __future__ import annotations

import os
from array import array
from bisect import bisect_right
from functools import partial
from itertools import chain, compress, repeat
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from lavra.llm.words import raw, slices, split_words
from lavra.session import stage

SIZE = 2048
END = 0
_MEMO_WORDS = 400_000
_MEMO_IDS = 6_000_000
_SLICE_BYTES = 4 << 20
# One call of the tokenizer costs more than a word does, so this many words go to it as one text.
_JOINED = 48

_encoders: dict[str, "_Encoder"] = {}


# Marks before which a word ends after a letter, unless a token that the tokenizer looks for as it stands has one.
_MARKS = "!\"#$%&()*+,./:;<=>?@[\\]^`{|}~"
# Texts on which encoding by words and as a whole must agree before words are trusted.
_PROBES = [
    left + mark + right
    for left in ("", "a", "The end", "don't", "x1", "É", "日本")
    for mark in (" ", "  ", "\n", " \n\t", ". ", " .", "...", "-", "_", "'", "7", "é", "👍", "\u00a0", "\u3000", "<|endoftext|>", *_MARKS)
    for right in ("", "b", "Of it", "s", "2", "ß", "語")
]


class _Encoder:
    """Ids of texts. Each distinct word is encoded once, if the tokenizer gives a text the ids of its parts
    one after the other: it drops white space, never joins over it, and splits letters from other marks.
    That is tried on ``_PROBES``, unless it is known; other tokenizers get whole texts.
    """

    def __init__(self, path: str, by_words: bool | None = None):
        # A task has one core; threads of the library's own would only hold memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.stops = np.zeros(256, bool)
        self.stops[[ord(m) for m in _MARKS if not any(m in a for a in added)]] = True
        norm = self.tokenizer.normalizer
        self.folds = (
            norm is not None
            and all(norm.normalize_str(a) == norm.normalize_str(a.lower()) for a in (*ascii_uppercase, ascii_uppercase))
            and not any(a.isalpha() for a in added)
        )
        alone = [(m, self.tokenizer.encode(m, add_special_tokens=False).ids) for m in "\x7f|+~"]
        self.mark = next(((m, ids[0]) for m, ids in alone if len(ids) == 1), None)
        self.forget()
        if by_words is None:
            probes = pa.array(_PROBES)
            by_words = all(np.array_equal(a, b) for a, b in zip(self._words(probes), self._texts(probes)))
            self.forget()
        self.by_words = by_words

    def forget(self):
        self.known: dict[str, int] = {}
        self.sizes, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and their bounds per text."""
        return self._words(texts) if self.by_words else self._texts(texts)

    def _texts(self, texts):
        ids, bounds = array("I"), array("q", [0])
        for at in range(0, len(texts), 64):
            block = [t or "" for t in texts.slice(at, 64).to_pylist()]
            for e in self.tokenizer.encode_batch_fast(block, add_special_tokens=False):
                ids.extend(e.ids)
                bounds.append(len(ids))
        return np.array(ids, np.uint32), np.array(bounds, np.int64)

    def _joined(self, words: list[str]):
        """Ids of all words in order, and how many each has.

        Words are joined, each with a mark of one id behind it. Where that id comes up in a word too there
        are more of them than words, and these words are encoded one by one.
        """
        encode = partial(self.tokenizer.encode_batch_fast, add_special_tokens=False)
        store, sizes = [], []
        for at in range(0, len(words), 64 * _JOINED):
            some = words[at : at + 64 * _JOINED]
            if self.mark:
                mark, mark_id = self.mark
                blocks = [f" {mark} ".join([*some[n : n + _JOINED], ""]) for n in range(0, len(some), _JOINED)]
                ids = np.fromiter(chain.from_iterable(e.ids for e in encode(blocks)), np.uint32)
                ends = np.flatnonzero(ids == mark_id)
                if len(ends) == len(some):
                    store.append(ids[ids != mark_id])
                    sizes.append(np.diff(ends, prepend=-1) - 1)
                    continue
            each = [e.ids for e in encode(some)]
            store.append(np.fromiter(chain.from_iterable(each), np.uint32))
            sizes.append(np.fromiter(map(len, each), np.int64))
        return np.concatenate(store), np.concatenate(sizes)

    def _trim(self):
        """Keep the words that most slices have used, half of what may be known at most."""
        order = np.argsort(-self.uses, kind="stable")[: _MEMO_WORDS // 2]
        order = order[np.cumsum(self.sizes[order]) <= _MEMO_IDS // 2]
        kept = np.zeros(len(self.sizes), bool)
        kept[order] = True
        self.known = {w: n for n, w in enumerate(compress(self.known, kept.tolist()))}
        self.store = self.store[np.repeat(kept, self.sizes)]
        self.sizes, self.uses = self.sizes[kept], self.uses[kept] // 2

    def _words(self, texts):
        words = split_words(texts, stops=self.stops)
        distinct = words.distinct
        if self.folds:
            distinct = pc.if_else(pc.ascii_is_alpha(distinct), pc.ascii_lower(distinct), distinct)
        distinct = distinct.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > _MEMO_WORDS or len(self.store) > _MEMO_IDS:
            self._trim()
        known = self.known
        place = np.fromiter(map(known.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            missing = [distinct[n] for n in fresh.tolist()]
            new = list(dict.fromkeys(missing))
            store, sizes = self._joined(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            place[fresh] = np.fromiter(map(known.__getitem__, missing), np.int64, len(missing))
            self.store, self.sizes = np.concatenate((self.store, store)), np.concatenate((self.sizes, sizes))
            self.uses = np.append(self.uses, np.zeros(len(new), np.int64))
        self.uses[place] += 1
        ends = np.concatenate(([0], np.cumsum(self.sizes * 4)))
        parts = [None, pa.py_buffer(ends), pa.py_buffer(self.store)]
        found = pa.Array.from_buffers(pa.large_binary(), len(known), parts).take(pa.array(place[words.codes]))
        data, ends = raw(found)
        return data.view(np.uint32), ends[words.bounds] // 4


def _occurrence(values: np.ndarray) -> np.ndarray:
    """For each value, how many equal ones stand before it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = np.flatnonzero(fresh)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    return out


def _cut(key, key_type, path: str, size: int, end: int):
    by_words = _Encoder(path).by_words  # probed once, on the driver
    fields = [(key, key_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.binary()), ("_part", pa.int64()), ("_rank", pa.int64())])

    def run(batches):
        if path not in _encoders:  # once in each Python worker
            _encoders[path] = _Encoder(path, by_words)
        encoder, part, seen = _encoders[path], TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, _SLICE_BYTES):
                ids, bounds = encoder(texts.slice(a, b - a))
                rows = np.arange(b - a)
                flat = np.insert(ids, bounds[1:], end).astype("<u4")
                ends = bounds[1:] + rows + 1
                begins = bounds[:-1] + rows
                pieces = -(-(ends - begins) // size)
                row = np.repeat(rows, pieces)
                piece = _occurrence(row)
                start = piece * size
                cuts = begins[row] + start
                length = np.minimum(size, ends[row] - cuts)
                edges = pa.py_buffer(np.append(cuts, len(flat)) .astype(np.int64) * 4)
                data = pa.Array.from_buffers(pa.large_binary(), len(row), [None, edges, pa.py_buffer(flat)])
                rank = seen[length] + _occurrence(length)
                np.add.at(seen, length, 1)
                keys = batch.column(0).slice(a, b - a).take(pa.array(row))
                columns = [keys, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length)]
                columns += [data.cast(pa.binary()), pa.array(np.full(len(row), part)), pa.array(rank)]
                for at in range(0, len(row), 512):
                    some = [c.slice(at, 512) for c in columns]
                    yield pa.RecordBatch.from_arrays(some, schema=schema)

    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, *, key="doc_id", text="text", size: int = SIZE, end: int = END
) -> DataFrame:
    """Every text as ids and the ``end`` id, cut into pieces of at most ``size`` ids.

    ``ids`` holds little-endian unsigned 32-bit ids. Null and empty texts are the end id alone. The
    tokenizer file must lie at the same path on every machine. Columns ``_part`` and ``_rank`` number the
    pieces of one length for ``pack``. Repeated rows give repeated pieces; other columns are not read.
    """
    string = docs.schema[key].dataType.simpleString() == "string"
    rows = docs.select(F.col(key) if string else F.col(key).cast("long"), F.col(text).cast("string").alias("_text"))
    out = f"`{key}` {'string' if string else 'long'}, piece int, start long, length long, ids binary, _part long, _rank long"
    return rows.mapInArrow(_cut(key, pa.string() if string else pa.int64(), tokenizer, size, end), out)


def _best_pair(lengths: np.ndarray, left: np.ndarray, room: int, over: int):
    """Two unpacked lengths with the largest sum up to ``room``, if it is above ``over``."""
    first = lengths[lengths < room]
    if not len(first):
        return None
    at = np.searchsorted(lengths, room - first, side="right") - 1
    at = np.minimum(at, np.arange(len(first)))
    at = at - ((at == np.arange(len(first))) & (left[first] < 2))
    total = np.where(at >= 0, first + lengths[at], 0)
    best = int(total.argmax())
    return (int(first[best]), int(lengths[at[best]])) if total[best] > over else None


def plan(counts: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Where the pieces of each length go: rows (length, first rank, copies, first sequence, offset).

    A sequence is filled greedily with the longest pieces that fit. If room is left, its smallest piece
    gives way to the two unpacked pieces that fill its place and the room best, if they fill it better.
    The pattern repeats as often as the counts allow, which is what packing one at a time would do.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    done = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    lengths = np.flatnonzero(left)
    while len(lengths):
        known = lengths.tolist()
        used: dict[int, int] = {}
        room, at = size, len(known)
        while room and (at := min(at, bisect_right(known, room))) > 0:
            length = known[at - 1]
            used[length] = min(int(left[length]), room // length)
            room -= used[length] * length
            at -= 1
        if room and sum(used.values()) > 1:
            small = min(used)
            free = left.copy()
            for length, n in used.items():
                free[length] -= n
            pair = _best_pair(np.flatnonzero(free), free, room + small, small)
            if pair:
                used[small] -= 1
                for length in pair:
                    used[length] = used.get(length, 0) + 1
        used = {length: n for length, n in used.items() if n}
        times = min(int(left[length]) // n for length, n in used.items())
        offset = 0
        for length, n in sorted(used.items(), reverse=True):
            rows.append((length, done[length], n, sequence, offset))
            done[length] += n * times
            left[length] -= n * times
            offset += n * length
        sequence += times
        lengths = lengths[left[lengths] > 0]
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _locate(shared):
    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows = shared.value
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        # Rows are sorted by (length, first rank); find the last one not beyond the piece.
        scale = np.int64(1) << np.int64(50)
        at = np.searchsorted(rows[:, 0] * scale + rows[:, 1], length * scale + rank, side="right") - 1
        _, first, copies, sequence, offset = rows[at].T
        turn, spot = np.divmod(rank - first, copies)
        return pa.StructArray.from_arrays(
            [pa.array(sequence + turn), pa.array(offset + spot * length)], ["sequence_id", "offset"]
        )

    return place


def pack(pieces: DataFrame, *, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``token_pieces``; further columns pass through.

    Every piece is placed once, sequences hold at most ``size`` ids and are gapless from 0. An empty
    table gives no rows.
    """
    pieces = stage(pieces, "pieces")
    by_part = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    by_part = stage(by_part, "piece-counts")
    counts = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("_n")).collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(plan(counts, size))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = pieces.join(base, ["length", "_part"])
    placed = ranked.withColumn("_place", _locate(shared)(F.col("length"), F.col("_rank") + F.col("_base")))
    kept = [c for c in pieces.columns if c not in ("_part", "_rank")]
    return placed.select(*kept, "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame, *, key="doc_id") -> DataFrame:
    """One row per sequence: its documents, where each begins, and all ids. At most ``size`` pieces meet."""
    part = F.struct("offset", F.col(key).alias("key"), "piece", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return rows.select(
        "sequence_id",
        F.col("p.key").alias("doc_ids"),
        F.col("p.piece").alias("pieces"),
        F.col("p.offset").alias("offsets"),
        F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
    )
