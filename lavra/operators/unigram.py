"""Training a unigram vocabulary (Kudo 2018, arXiv:1804.10959) as Spark jobs over word counts.

The words stay distributed: each becomes a row of piece numbers, one per substring, stored once. Every
step of the training then reads those numbers and never the strings. What travels is the model: one
score per piece out, at most ``seed_size`` of them, and one sum per piece back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lavra.functions.lattice import (
    best_path,
    by_length,
    edge_pieces,
    edge_scores,
    expected_uses,
    plain_uses,
    segment,
    sums_are_plain,
)
from lavra.functions.suffixes import Best, PrefixSums, suffixes
from lavra.functions.tokens import SPECIAL_TOKENS, UNK, VOCABULARY_SIZE
from lavra.operators.cuts import top_rows
from lavra.operators.encoding import UNKNOWN_PENALTY
from lavra.operators.skew import heavy_join
from lavra.operators.vocabulary import numbered, word_counts
from lavra.session import PACKED, bound_batches, fence, spread, stage

# Fixed values from public implementations of the paper.
SEED_SIZE = 1_000_000
LONGEST_PIECE = 16
SHRINK = 0.75
SUB_ITERATIONS = 2
HEADROOM = 1.1
MIN_USE = 0.5

_LONG_WORD = 256
# Longer words are trained on in parts of this many characters. Seeds are counted on whole words.
TRAINED_CHARS = 256
# Characters of words whose substrings are looked up at once, and pieces whose sums travel in one row.
_LOOKED_UP = 400_000
_SUMS = 1 << 14
# Edges of the words of one length that are stored as one value, about.
_EDGES = 1 << 17


def byte_alphabet() -> set[str]:
    """256 characters, one per byte: printable bytes stand for themselves, others move above U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = (0x100 + i for i, _ in enumerate(b for b in range(256) if b not in plain))
    return {chr(c) for c in (*plain, *moved)}


def substrings(word, shortest: int, longest: int) -> Column:
    """All substrings of a word within the length limits, as an array with repeats."""
    word = F.col(word) if isinstance(word, str) else word
    n = F.length(word)

    def from_start(start):
        most = F.least(F.lit(longest), n - start + 1)
        lengths = F.filter(F.sequence(F.lit(1), most), lambda k: k >= shortest)
        return F.transform(lengths, lambda k: F.substring(word, start, k))

    return F.flatten(F.transform(F.sequence(F.lit(1), n), from_start))


def explode_substrings(words: DataFrame, shortest: int, longest: int, keep: list[str]) -> DataFrame:
    """One row per substring of ``word``, as ``piece``, beside the kept columns.

    Long words are cut from their characters: finding a place in a string takes a walk from its start.
    """
    n = F.length("word")
    short = words.where((n >= shortest) & (n <= _LONG_WORD)).select(
        *keep, F.explode(substrings("word", shortest, longest)).alias("piece")
    )
    chars = fence(words.where(n > _LONG_WORD), F.split("word", "").alias("_chars"), keep=keep)

    def from_start(start):
        lengths = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.size("_chars") - start + 1))
        return F.transform(lengths, lambda k: F.array_join(F.slice("_chars", start, k), ""))

    starts = F.sequence(F.lit(1), F.size("_chars") - shortest + 1)
    pieces = F.explode(F.flatten(F.transform(starts, from_start))).alias("piece")
    return short.unionByName(chars.select(*keep, pieces))


def _suffix_rows(shortest: int, longest: int):
    def cut(batches):
        for batch in batches:
            for block in suffixes(batch.column("word"), batch.column("count").to_numpy(), shortest, longest):
                yield from block.to_batches()

    return cut


def _substring_totals(shortest: int, longest: int, limit: int | None):
    names = ["piece", "uses", "edge"]

    def total(batches):
        sums, best = PrefixSums(shortest, longest), Best(limit or 0)

        def rows(found):
            for pieces, uses, edges in found:
                if limit is None:
                    yield pa.RecordBatch.from_arrays([pieces, pa.array(uses), pa.array(edges)], names=names)
                    continue
                for at in (pa.array(np.flatnonzero(edges)), pa.array(np.flatnonzero(~edges))):
                    if not len(at):
                        continue
                    taken, amounts = pieces.take(at), uses[at.to_numpy()]
                    if edges[at[0].as_py()]:
                        yield pa.RecordBatch.from_arrays([taken, pa.array(amounts), pa.array(np.ones(len(at), bool))], names=names)
                    else:
                        best.add(taken, amounts)

        for batch in batches:
            if batch.num_rows:
                yield from rows(sums(batch.column("suffix"), batch.column("uses").to_numpy()))
        yield from rows(sums.rest())
        if limit is not None:
            pieces, uses = best.taken()
            yield pa.RecordBatch.from_arrays([pieces, pa.array(uses), pa.array(np.zeros(len(uses), bool))], names=names)

    return total


def candidate_pieces(counts: DataFrame, *, longest: int = LONGEST_PIECE, limit: int | None = None) -> DataFrame:
    """Every substring of two or more characters with its weighted count and count x length.

    Words give one row per place, their suffixes cut at the longest piece. Range partitions of sorted
    suffixes then hold each substring in one stretch, so it is added up where it lies; only what may go on
    in a neighbouring partition, a few strings of each, is added up again. With a ``limit`` each task drops
    what cannot be among that many largest.
    """
    found = counts.select("word", "count").mapInArrow(_suffix_rows(2, longest), "suffix string, uses long")
    ordered = found.repartitionByRange("suffix").sortWithinPartitions("suffix")
    totals = ordered.mapInArrow(_substring_totals(2, longest, limit), "piece string, uses long, edge boolean")
    totals = stage(totals, "substrings")
    inner = totals.where(~F.col("edge")).select("piece", "uses")
    edges = totals.where("edge").groupBy("piece").agg(F.sum("uses").alias("uses"))
    return inner.unionByName(edges).withColumn("weight", F.col("uses") * F.length("piece"))


def seed_pieces(
    counts: DataFrame, *, size: int = SEED_SIZE, longest: int = LONGEST_PIECE
) -> DataFrame:
    """The ``size`` candidates with the largest weight, ties in piece order."""
    candidates = candidate_pieces(counts, longest=longest, limit=size)
    return top_rows(candidates, by="weight", then="piece", n=size)


def character_counts(counts: DataFrame) -> DataFrame:
    chars = counts.select(F.explode(F.split("word", "")).alias("piece"), "count")
    return chars.where(F.col("piece") != "").groupBy("piece").agg(F.sum("count").alias("uses"))


def _in_parts(counts: DataFrame) -> DataFrame:
    """Words longer than ``TRAINED_CHARS`` in parts, so that no row of the lattice grows with its word."""

    def cut(batches):
        for batch in batches:
            for word, count in zip(batch.column("word").to_pylist(), batch.column("count").to_pylist()):
                parts = [word[a : a + TRAINED_CHARS] for a in range(0, len(word), TRAINED_CHARS)]
                for at in range(0, len(parts), 256):
                    some = parts[at : at + 256]
                    yield pa.RecordBatch.from_pydict({"word": some, "count": [count] * len(some)})

    long = F.length("word") > TRAINED_CHARS
    return counts.where(~long).unionByName(counts.where(long).mapInArrow(cut, "word string, count long"))


def _gathered(batches):
    """Batches put together to about ``_LOOKED_UP`` characters of words."""
    held, chars = [], 0
    for batch in batches:
        held.append(batch)
        chars += pc.sum(pc.utf8_length(batch.column("word"))).as_py() or 0
        if chars >= _LOOKED_UP:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, chars = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _as_words(spark: SparkSession, names: pa.Array) -> DataFrame:
    """Pieces as words, each counted by its number. Tasks make the rows, and the driver only sends the pieces."""
    shared = spark.sparkContext.broadcast(names)

    def words(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([shared.value.take(batch.column("id")), batch.column("id")], names=["word", "count"])

    return spark.range(len(names)).mapInArrow(words, "word string, count long")


def lattice(counts: DataFrame, pieces: list[str] | pa.Array, *, longest: int = LONGEST_PIECE, blocks: bool = False) -> DataFrame:
    """Each word as its length, its count and the piece number of every substring. Narrow, stored once.

    With ``blocks`` a row holds words of one length, as the bytes of their counts and, compressed, of their piece
    numbers (edges x words), the way that the steps of the training take them.
    """
    shared = counts.sparkSession.sparkContext.broadcast(pieces if isinstance(pieces, pa.Array) else pa.array(pieces, pa.string()))

    def number(batches):
        known = shared.value
        for batch in _gathered(batches):  # each look-up hashes all pieces
            for n, rows, pieces in edge_pieces(batch.column("word"), longest, known):
                counts_ = batch.column("count").take(pa.array(rows))
                if blocks:
                    yield from _blocks(n, counts_.to_numpy(), pieces)
                    continue
                edges = pieces.T.astype(np.int32)
                width = edges.shape[1]
                starts = pa.array(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32))
                lists = pa.ListArray.from_arrays(starts, pa.array(edges.ravel()))
                lengths = pa.array(np.full(len(rows), n, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([lengths, counts_, lists], ["n", "count", "edges"])

    kinds = ("binary", "binary") if blocks else ("long", "array<int>")
    numbered_ = counts.select("word", "count").mapInArrow(number, "n int, count {}, edges {}".format(*kinds))
    if blocks:
        bound_batches(counts.sparkSession)
    stored = stage(numbered_, "lattice", **(PACKED | {"compression": "none"} if blocks else {}))
    shared.destroy()
    return spread(stored)


def _blocks(n: int, counts: np.ndarray, pieces: np.ndarray):
    """Words of one length in rows of about ``_EDGES`` edges."""
    edges, step = pieces.astype(np.int32), max(_EDGES // len(pieces), 1)
    for at in range(0, len(counts), step):
        some = [counts[at : at + step].astype(np.int64).tobytes(), pa.compress(edges[:, at : at + step].tobytes(), "zstd", asbytes=True)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([x], pa.binary()) for x in some)], ["n", "count", "edges"])


def _groups(batch, longest: int):
    """Words of a batch by length: (length, counts, piece numbers as edges x words)."""
    if pa.types.is_binary(batch.schema.field("edges").type):
        width = {}
        for n, counts, edges in zip(batch.column("n").to_pylist(), batch.column("count"), batch.column("edges")):
            counts = np.frombuffer(counts.as_buffer(), np.int64)
            size = 4 * len(counts) * width.setdefault(n, int(np.minimum(longest, np.arange(n) + 1).sum()))
            edges = pa.decompress(edges.as_buffer(), size, "zstd")
            yield n, counts, np.frombuffer(edges, np.int32).reshape(-1, len(counts)).astype(np.intp)
        return
    lists = batch.column("edges")
    flat, starts = lists.values.to_numpy().astype(np.intp), lists.offsets.to_numpy()
    counts = batch.column("count").to_numpy()
    for n, rows in by_length(batch.column("n").to_numpy()):
        width = starts[rows[0] + 1] - starts[rows[0]]
        yield n, counts[rows], flat[starts[rows][None, :] + np.arange(width)[:, None]]


def _unknown(scores: np.ndarray) -> float:
    return float(scores[~np.isneginf(scores)].min()) - UNKNOWN_PENALTY


def _summed(words: DataFrame, scores: np.ndarray, uses: Callable, longest: int) -> np.ndarray:
    """Use of each piece over all words, weighted by their counts. A task adds up its words; the sums of the
    pieces still in the model travel in rows of ``_SUMS`` and are added up by those."""
    shared = words.sparkSession.sparkContext.broadcast(scores)
    live = np.flatnonzero(~np.isneginf(scores))

    def partial(batches):
        table = shared.value
        totals, used = np.zeros(len(table) + 1), uses(table, longest)  # edges without a piece count last
        for batch in batches:
            for n, counts, pieces in _groups(batch, longest):
                np.add.at(totals, *used(pieces, counts, n))
        sums = totals[:-1][~np.isneginf(table)]
        for block, at in enumerate(range(0, len(sums), _SUMS)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "sums": [sums[at : at + _SUMS].tobytes()]})

    def added(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for sums in part.column("sums"):
                more = np.frombuffer(sums.as_buffer())
                total = more.copy() if total is None else total + more
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "sums": [total.tobytes()]})

    parts = words.mapInArrow(partial, "block int, sums binary")
    rows = parts.groupBy("block").applyInArrow(added, "block int, sums binary").toArrow()
    shared.destroy()
    out = np.zeros(len(scores))
    for block, sums in zip(rows["block"].to_pylist(), rows["sums"]):
        out[live[block * _SUMS : (block + 1) * _SUMS]] = np.frombuffer(sums.as_buffer())
    return out


def _by_piece(sums: DataFrame, shared, size: int) -> np.ndarray:
    """One number per piece, gathered as an array; pieces not named get 0."""
    rows = sums.toArrow()
    shared.destroy()
    out = np.zeros(size)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def _all_uses(scores: np.ndarray, longest: int) -> Callable:
    """Pieces and how often each is expected."""
    unknown = _unknown(scores)
    weights = np.append(np.exp(scores), 0.0)
    plain = scores.max() <= 0

    def used(pieces, counts, n):
        if plain and sums_are_plain(n, unknown):
            each = plain_uses(pieces, n, longest, weights, unknown)
        else:
            each = expected_uses(edge_scores(pieces, n, longest, scores, unknown), n, longest)
        each *= counts
        return pieces.ravel(), each.ravel()

    return used


def _best_uses(scores: np.ndarray, longest: int) -> Callable:
    """The pieces of the best segmentations and how often each is used."""
    unknown = _unknown(scores)

    def used(pieces, counts, n):
        _, path = best_path(edge_scores(pieces, n, longest, scores, unknown), n, longest)
        step, word = np.nonzero(path >= 0)
        return pieces[path[step, word], word], counts[word].astype(float)

    return used


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    for _ in range(6):
        shift -= 1 / x
        x = x + 1
    inv = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv / 252))


def reestimate(
    words: DataFrame, scores: np.ndarray, required: np.ndarray, longest: int
) -> np.ndarray:
    """One EM step: expected uses, then log probabilities; hardly used pieces leave."""
    used = _summed(words, scores, _all_uses, longest)
    kept = ~np.isneginf(scores) & ((used >= MIN_USE) | required)
    used = np.maximum(used, MIN_USE)
    total = _digamma(used[kept].sum())
    return np.where(kept, _digamma(used) - total, -np.inf)


def removal_cost(pieces: DataFrame, scores: np.ndarray, longest: int) -> np.ndarray:
    """How far each piece's best segmentation without itself scores below it; 0 for pieces no longer in the model.

    ``pieces`` is the lattice of the pieces, each counted by its number.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(scores)

    def cost(batches):
        table = shared.value
        unknown = _unknown(table)
        for batch in batches:
            for n, numbers, edges in _groups(batch, longest):
                left = np.flatnonzero(~np.isneginf(table[numbers]))
                if not len(left):
                    continue
                numbers, edges = numbers[left], edges[:, left]
                edge = edge_scores(edges, n, longest, table, unknown)
                edge[n - 1] = -np.inf  # the edge over the whole piece
                drop = table[numbers] - best_path(edge, n, longest)[0]
                yield pa.RecordBatch.from_pydict({"piece": numbers.astype(np.int32), "drop": drop})

    drops = pieces.where("n > 1").mapInArrow(cost, "piece int, drop double")
    return _by_piece(drops, shared, len(scores))


def prune(
    words: DataFrame, pieces: DataFrame, scores: np.ndarray, required: np.ndarray, keep: int, longest: int
) -> np.ndarray:
    """Keep the pieces whose removal would cost the most likelihood over the best segmentations."""
    used = _summed(words, scores, _best_uses, longest)
    open_ = ~np.isneginf(scores) & ~required & (used > 0)
    drop = removal_cost(pieces, scores, longest)
    loss = np.full(len(scores), -np.inf)
    loss[open_] = used[open_] * drop[open_]
    fixed = ~np.isneginf(scores) & required
    room = max(keep - int(fixed.sum()), 0)
    ranked = np.argsort(-loss, kind="stable")[: min(room, int(open_.sum()))]
    fixed[ranked] = True
    return np.where(fixed, scores, -np.inf)


def train_unigram(
    docs: DataFrame,
    *,
    size: int = VOCABULARY_SIZE,
    seed_size: int = SEED_SIZE,
    longest: int = LONGEST_PIECE,
    shrink: float = SHRINK,
    sub_iterations: int = SUB_ITERATIONS,
    alphabet: set[str] | None = None,
    text="text",
) -> DataFrame:
    """A vocabulary of ``size`` pieces: special tokens, every needed character, then the best pieces."""
    counts = spread(stage(word_counts(docs, text=text), "word-counts"))
    chars = {r["piece"]: r["uses"] for r in character_counts(counts).collect()}
    needed = set(chars) | (byte_alphabet() if alphabet is None else alphabet)
    seeds = seed_pieces(counts, size=seed_size, longest=longest).select("piece", "weight").toArrow()
    names = pa.chunked_array([*seeds["piece"].chunks, pa.array(list(chars), pa.string())]).combine_chunks()
    weights = np.concatenate([seeds["weight"].to_numpy(), np.array(list(chars.values()), np.int64)])
    if not len(names):  # an empty corpus: the alphabet with equal scores
        first = sorted(needed)[: size - len(SPECIAL_TOKENS)]
        return numbered([(c, -math.log(len(first))) for c in first], docs.sparkSession)
    order = pc.sort_indices(names)  # by bytes, as by code points
    names, weights = names.take(order), weights[order.to_numpy()]
    required = pc.is_in(names, value_set=pa.array(sorted(needed), pa.string())).to_numpy(zero_copy_only=False)
    scores = np.log(weights.astype(float))
    scores -= np.log(np.exp(scores).sum())

    words = lattice(_in_parts(counts), names, longest=longest, blocks=True)
    pieces = lattice(_as_words(counts.sparkSession, names), names, longest=longest, blocks=True)
    room = size - len(SPECIAL_TOKENS)
    target = max(int(room * HEADROOM), len(needed))
    while True:
        for _ in range(sub_iterations):
            scores = reestimate(words, scores, required, longest)
        left = int((~np.isneginf(scores)).sum())
        if left <= target:
            break
        scores = prune(words, pieces, scores, required, max(target, int(left * shrink)), longest)
        if int((~np.isneginf(scores)).sum()) == left:
            break
    live = np.flatnonzero(~np.isneginf(scores))
    final = dict(zip(names.take(pa.array(live)).to_pylist(), scores[live].tolist()))
    return numbered(_finish(final, needed, chars, room), docs.sparkSession)


def _finish(scores, needed, chars, room) -> list[tuple[str, float]]:
    lowest = min(scores.values())
    first = sorted(needed, key=lambda c: (-chars.get(c, 0), c))[:room]
    final = {c: scores.get(c, lowest - 1e-4 * (i + 1)) for i, c in enumerate(first)}
    for piece, score in sorted(scores.items(), key=lambda ps: (-ps[1], ps[0])):
        if len(final) >= room:
            break
        final.setdefault(piece, score)
    return sorted(final.items(), key=lambda ps: (-ps[1], ps[0]))


def segment_words_by_join(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """Ids of each distinct word when the vocabulary is too large to send out.

    Substrings meet the vocabulary in an equi-join; a word's candidates, at most ``longest`` per
    character, are then segmented together.
    """
    plain = vocab.where(~F.col("is_special"))
    longest, lowest = plain.agg(F.max(F.length("piece")), F.min("score")).first()
    edges = explode_substrings(words, 1, longest, ["word"])
    table = plain.select("piece", "id", "score")
    found = heavy_join(edges, table, "piece", "inner")
    each = found.groupBy("word").agg(F.collect_list(F.struct("piece", "id", "score")).alias("edges"))

    def ids_of(batches):
        for batch in batches:
            local = {r["piece"]: (r["id"], r["score"]) for rows in batch["edges"] for r in rows}
            ids = [i for i, _ in local.values()]
            scores = np.array([s for _, s in local.values()])
            split = segment(
                pa.array(batch["word"]), pa.array(local), scores, longest, lowest - UNKNOWN_PENALTY
            )
            coded = [[ids[p] if p >= 0 else UNK for p in pieces] for pieces in split]
            yield pd.DataFrame({"word": batch["word"], "ids": coded})

    return each.mapInPandas(ids_of, "word string, ids array<int>")
