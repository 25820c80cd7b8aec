"""Text to token ids and back.

While the vocabulary is under a checked size it travels to the executors once and every document is
encoded where it lies: no shuffle, one Arrow batch at a time, each distinct word of a batch looked up
once. A vocabulary beyond that size is joined instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lavra.functions.lattice import segmented
from lavra.functions.markup import offsets, relist
from lavra.functions.tokens import (
    CONTEXT_SIZE,
    SPECIAL_TOKENS,
    UNK,
    attention_mask,
    join_pieces,
    pad_right,
    special_tokens_mask,
    strip_specials,
    template_single,
    truncate,
)
from lavra.operators.vocabulary import BROADCAST_PIECES, with_tokens
from lavra.session import PACKED, fence, fresh, stage

_MEMO_WORDS = 500_000
# Fixed value: how far an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0

_built: dict[int, object] = {}


def load_pieces(vocab: DataFrame, limit: int = BROADCAST_PIECES) -> list[tuple[str, float]] | None:
    """Pieces and scores in id order, or None for a vocabulary of more than ``limit`` rows."""
    rows = vocab.select("id", "piece", "score").limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return None
    rows = rows.sort_by("id")
    return list(zip(rows["piece"].to_pylist(), rows["score"].to_pylist()))


def _send(vocab: DataFrame, pieces):
    """A broadcast of the vocabulary; one that is too large is refused, not sent."""
    pieces = load_pieces(vocab) if pieces is None else pieces
    if pieces is None:
        raise ValueError(f"vocabulary beyond {BROADCAST_PIECES} rows; encode_columns and with_pieces join it instead")
    return vocab.sparkSession.sparkContext.broadcast(pieces)


def _once_per_worker(shared, build):
    """Build a lookup from a broadcast value once in each Python worker."""
    if id(shared) not in _built:
        if len(_built) >= 4:
            _built.clear()
        _built[id(shared)] = (shared, build(shared.value))
    return _built[id(shared)][1]


def _names(pieces) -> pa.Array:
    return pa.array([p for p, _ in pieces])


def word_encoder(vocab: DataFrame, pieces=None, *, unknown: int = UNK, specials=None):
    """Column function: array of words to array of ids, unknown words to ``[UNK]``.

    ``specials`` is there for the sake of the other encoder: special tokens are words like others here.
    """
    shared = _send(vocab, pieces)

    @F.arrow_udf("array<int>")
    def encode(tokens: pa.Array) -> pa.Array:
        known = _once_per_worker(shared, _names)
        ids = pc.fill_null(pc.index_in(tokens.flatten(), value_set=known), unknown)
        return relist(tokens, ids)

    return encode


# Distinct words of a batch that are segmented at once.
_SEGMENT_WORDS = 20_000


class _Memo:
    """The ids of words that a worker has met, at most ``_MEMO_WORDS`` before a batch; ``whole`` are always known."""

    def __init__(self, whole: dict[str, list[int]]):
        self.whole = whole
        self.forget()

    def forget(self) -> None:
        self.places = {w: i for i, w in enumerate(self.whole)}
        self.lists = pa.array(list(self.whole.values()), pa.list_(pa.int32()))

    def ids(self, words: pa.Array, ids_of) -> pa.Array:
        """The ids of distinct words; those of new ones by ``ids_of``, ``_SEGMENT_WORDS`` at once."""
        if len(self.places) > _MEMO_WORDS:
            self.forget()
        names = words.to_pylist()
        new = [i for i, w in enumerate(names) if w not in self.places]
        if new:
            some = words.take(pa.array(new))
            parts = [ids_of(some.slice(at, _SEGMENT_WORDS)) for at in range(0, len(new), _SEGMENT_WORDS)]
            self.places.update(zip(map(names.__getitem__, new), range(len(self.lists), len(self.lists) + len(new))))
            self.lists = pa.concat_arrays([self.lists, *parts])
        return self.lists.take(pa.array([self.places[w] for w in names], pa.int64()))


def unigram_encoder(vocab: DataFrame, pieces=None, *, per_token: bool = False, unknown: int = UNK, specials: dict[str, int] | None = None):
    """Column function: array of words to array of ids by best segmentation.

    With ``per_token`` the ids of each word stay together in an inner array. A run of characters
    without a piece becomes one ``[UNK]``. With ``specials``, their ids by name, a word that is one of them
    gets its id, and they may be pieces of other words as well; without, the first rows of the vocabulary
    are special tokens that no word holds.
    """
    shared = _send(vocab, pieces)
    whole = {name: [i] for name, i in (specials or {}).items()}

    def build(rows):
        known = _names(rows)
        scores = np.array([s for _, s in rows], dtype=float)
        first = len(SPECIAL_TOKENS) if specials is None else 0
        scores[:first] = -np.inf
        plain = scores[first:]
        lowest = (plain.min() if len(plain) else 0.0) - UNKNOWN_PENALTY
        return [known, scores, max(len(p) for p, _ in rows), lowest], _Memo(whole)

    @F.arrow_udf("array<array<int>>" if per_token else "array<int>")
    def encode(tokens: pa.Array) -> pa.Array:
        model, memo = _once_per_worker(shared, build)
        coded = tokens.flatten().dictionary_encode()

        def ids_of(words: pa.Array) -> pa.Array:
            found = segmented(words, *model)
            pieces = found.values.to_numpy()
            return pa.ListArray.from_arrays(found.offsets, pa.array(np.where(pieces < 0, unknown, pieces), pa.int32()))

        each = memo.ids(coded.dictionary, ids_of).take(coded.indices)
        if per_token:
            return relist(tokens, each)
        starts = offsets(pc.list_value_length(each)).take(offsets(pc.list_value_length(tokens)))
        return pa.ListArray.from_arrays(starts, each.flatten(), mask=tokens.is_null())

    return encode


def piece_lookup(vocab: DataFrame, pieces=None):
    """Column function: array of ids to array of pieces."""
    shared = _send(vocab, pieces)

    @F.arrow_udf("array<string>")
    def look_up(ids: pa.Array) -> pa.Array:
        known = _once_per_worker(shared, _names)
        return relist(ids, known.take(ids.flatten()))

    return look_up


# Elements of the arrays of one chunk of rows, about; a longer array is a chunk of its own.
_CHUNK = 1 << 20


def _cut_chunks(batches, column: str):
    """Rows in stretches of about ``_CHUNK`` elements, over the bounds of batches."""
    held, elements = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(int(np.searchsorted(ends, before + _CHUNK - elements, side="right")), at + (not held))
            if stop > at:
                held.append(batch.slice(at, stop - at))
                elements, at = elements + int(ends[stop - 1] - before), stop
            if at < batch.num_rows or elements >= _CHUNK:
                yield pa.Table.from_batches(held)
                held, elements = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _pack(column: str, kept: list[str]):
    """Each chunk as one row: its distinct elements, and its rows with the places of theirs among those."""

    def pack(batches):
        for rows in _cut_chunks(batches, column):
            lists = rows.column(column).combine_chunks()
            coded = lists.flatten().dictionary_encode(null_encoding="encode")
            size = len(coded.dictionary)
            narrow = pa.uint8() if size <= 1 << 8 else pa.uint16() if size <= 1 << 16 else pa.int32()
            places = relist(lists, coded.indices.cast(narrow))
            columns = [places, *(rows.column(c).combine_chunks() for c in kept)]
            stored = pa.RecordBatch.from_arrays(columns, names=[fresh("_places", kept), *kept])
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, stored.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(stored)
            keys = pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), coded.dictionary)
            yield pa.RecordBatch.from_arrays([keys, pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["keys", "data"])

    return pack


def _looked_up(
    rows: DataFrame, table: DataFrame, column: str, out: str, kind: T.DataType, otherwise: Column, *, keep: list[str], flat: bool = False
) -> DataFrame:
    """The columns ``keep`` and the values of all elements of an array, in order, by a join with ``table`` (``key``, ``value``).

    Rows are put together into chunks, fixed by writing them, so keys may repeat or be null. What is joined are
    the distinct elements of each chunk, not every place they stand at, so an element on all rows has one row
    per chunk; then each chunk meets the values of its own elements. Chunks are written and move as compressed
    bytes, in which an element is its place among those of the chunk. With ``flat`` the values are lists and run on.
    """
    kept = [c for c in keep if c != out]
    keys = T.StructField("keys", T.ArrayType(rows.schema[column].dataType.elementType))
    packed = T.StructType([keys, T.StructField("data", T.BinaryType())])
    chunks = rows.select(*dict.fromkeys([*kept, column])).mapInArrow(_pack(column, kept), packed)
    stored = stage(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks", **PACKED)
    places = F.transform("keys", lambda key, place: F.struct(place.alias("place"), key.alias("key")))
    each = stored.select(F.col("chunk").alias("of"), F.inline(places))
    found = each.join(table, "key", "left").select("of", "place", F.coalesce("value", otherwise).alias("value"))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        stored_rows = pa.ipc.open_stream(left.column("data")[0].as_buffer()).read_all()
        lists = stored_rows.column(0).combine_chunks()
        at = pc.index_in(lists.flatten().cast(pa.int32()), value_set=right.column("place").combine_chunks())
        values = right.column("value").combine_chunks().take(at)
        if flat:
            starts = offsets(pc.list_value_length(values)).take(offsets(pc.list_value_length(lists)))
            done = pa.ListArray.from_arrays(starts, values.flatten(), mask=lists.is_null())
        else:
            done = relist(lists, values)
        return stored_rows.select(kept).append_column(out, done)

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(out, kind)])
    return stored.select("chunk", "data").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(look_up, schema)


def encode_by_join(
    tokenized: DataFrame, word_ids: DataFrame, *, tokens="tokens", out="ids", per_token: bool = False
) -> DataFrame:
    """Encode through a join, for vocabularies too large to send to every executor.

    ``word_ids`` maps a word to its array of ids; ids come back in order per document, with ``per_token``
    those of each word in an inner array.
    """
    inner = T.ArrayType(T.IntegerType())
    kind = T.ArrayType(inner) if per_token else inner
    table = word_ids.select(F.col("word").alias("key"), F.col("ids").alias("value"))
    others = [c for c in tokenized.columns if c != tokens]
    found = _looked_up(tokenized, table, tokens, out, kind, F.array(F.lit(UNK)), keep=others, flat=not per_token)
    return found.select(*others, F.coalesce(out, F.array().cast(kind)).alias(out))


def word_id_table(vocab: DataFrame) -> DataFrame:
    """Words and their one id as an array, for ``encode_by_join``."""
    plain = vocab.where(~F.col("is_special"))
    return plain.select(F.col("piece").alias("word"), F.array("id").alias("ids"))


def encode_columns(
    tokenized: DataFrame, vocab: DataFrame, columns: dict[str, str], *, model="word", limit: int = BROADCAST_PIECES
) -> DataFrame:
    """Replace columns of pre-tokens by columns of ids without special tokens.

    ``columns`` maps each to the name of its ids; ``model`` is ``word`` or ``unigram``. A vocabulary that is
    sent out is read once and serves all columns in one pass; a larger one is joined column by column.
    """
    pieces = load_pieces(vocab, limit)
    if pieces is not None:
        encoder = (word_encoder if model == "word" else unigram_encoder)(vocab, pieces)
        others = [c for c in tokenized.columns if c not in columns]
        return fence(tokenized, *[encoder(F.col(c)).alias(out) for c, out in columns.items()], keep=others)
    for tokens, out in columns.items():
        table = word_id_table(vocab) if model == "word" else unigram_id_table(tokenized, vocab, tokens)
        tokenized = encode_by_join(tokenized, table, tokens=tokens, out=out)
    return tokenized


def unigram_id_table(tokenized: DataFrame, vocab: DataFrame, tokens: str) -> DataFrame:
    """The distinct words of a column of pre-tokens with the ids of their pieces, for ``encode_by_join``."""
    from lavra.operators.unigram import segment_words_by_join

    words = stage(tokenized.select(F.explode(tokens).alias("word")).distinct(), "words")
    return segment_words_by_join(words, vocab)


def encode_tokens(
    tokenized: DataFrame, vocab: DataFrame, *, tokens="tokens", out="ids", model="word", limit: int = BROADCAST_PIECES
) -> DataFrame:
    """Replace pre-tokens by ids without special tokens. ``model`` is ``word`` or ``unigram``."""
    return encode_columns(tokenized, vocab, {tokens: out}, model=model, limit=limit)


def with_pieces(
    rows: DataFrame, vocab: DataFrame, *, ids="ids", out="pieces", limit: int = BROADCAST_PIECES
) -> DataFrame:
    """Add the pieces of an array of ids, in order; a vocabulary beyond ``limit`` rows is joined."""
    pieces = load_pieces(vocab, limit)
    if pieces is not None:
        return rows.withColumn(out, piece_lookup(vocab, pieces)(F.col(ids)))
    table = vocab.select(F.col("id").alias("key"), F.col("piece").alias("value"))
    # An id that is not in the vocabulary has a null piece; an empty array stays empty, a null one null.
    nothing = F.lit(None).cast("string")
    return _looked_up(rows, table, ids, out, T.ArrayType(T.StringType()), nothing, keep=rows.columns)


def encode_documents(docs: DataFrame, vocab: DataFrame, *, model="word", text="text") -> DataFrame:
    """Text to ids: normalise, pre-tokenise, encode. No special tokens, no truncation."""
    return encode_tokens(with_tokens(docs, text=text), vocab, model=model)


def model_rows(
    encoded: DataFrame, *, max_length: int = CONTEXT_SIZE, pad: bool = False, ids="ids"
) -> DataFrame:
    """Ids to rows a model reads: truncated, framed by special tokens, with the three masks."""
    others = [c for c in encoded.columns if c != ids]
    cut = fence(encoded, truncate(ids, max_length).alias("_ids"), keep=others)
    n = F.size("_ids")
    total = max_length if pad else None
    row = template_single("_ids")
    length = F.lit(max_length) if pad else n + 2
    return cut.select(
        *others,
        (pad_right(row, max_length) if pad else row).alias("input_ids"),
        F.array_repeat(F.lit(0), length.cast("int")).alias("token_type_ids"),
        attention_mask(n, total).alias("attention_mask"),
        special_tokens_mask(n, total).alias("special_tokens_mask"),
    )


def decode(ids: Column, look_up, *, skip_specials: bool = True) -> Column:
    """Ids to text. Not an inverse: every piece carries its own space."""
    return join_pieces(look_up(strip_specials(ids) if skip_specials else ids))


def decoded(
    rows: DataFrame, vocab: DataFrame, *, ids="ids", out="text", skip_specials: bool = True, limit: int = BROADCAST_PIECES
) -> DataFrame:
    """Add the text of an array of ids, for a vocabulary of any size."""
    plain = rows.withColumn("_plain", strip_specials(ids) if skip_specials else F.col(ids))
    found = with_pieces(plain, vocab, ids="_plain", out="_pieces", limit=limit)
    return found.withColumn(out, join_pieces("_pieces")).drop("_plain", "_pieces")
