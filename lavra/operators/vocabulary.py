"""Word counts, the word-level vocabulary, and keeping vocabularies as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lavra import schemas
from lavra.functions.markup import compose, compose_each
from lavra.functions.text import lower, open_piece, pre_tokens, raw_pre_tokens, straight_quotes
from lavra.functions.tokens import SPECIAL_TOKENS, VOCABULARY_SIZE
from lavra.operators.cuts import number_rows, top_rows
from lavra.session import fence

# Vocabularies up to this many rows pass through the driver and are sent to the executors.
BROADCAST_PIECES = 2_000_000
_COUNTED_CHARS = 64


def normalize(column) -> Column:
    """Straight quotes, NFC, lower case, in that order."""
    return lower(compose(straight_quotes(column)))


def normalize_each(column) -> Column:
    """The same for every string in an array."""
    column = F.col(column) if isinstance(column, str) else column
    quoted = F.array_join(column, "").rlike("``|''")
    straight = F.when(quoted, F.transform(column, straight_quotes)).otherwise(column)
    return F.transform(compose_each(straight), lower)


def with_tokens(docs: DataFrame, *, text="text", out="tokens") -> DataFrame:
    """Replace the text by its pre-tokens, computed once however often they are used."""
    others = [c for c in docs.columns if c != text]
    return fence(docs, pre_tokens(normalize(text)).alias(out), keep=others)


def word_counts(docs: DataFrame, *, text="text") -> DataFrame:
    """Occurrences of each pre-token. Counted map-side, so frequent words cost one row per task.

    No pre-token holds a space, so what stands between spaces is counted first and searched once for each
    distinct string; strings beyond ``_COUNTED_CHARS`` are searched where they lie, and do not travel.
    """
    parts = docs.select(F.explode(F.split(normalize(text), " ")).alias("part")).where(F.col("part") != "")
    long = F.length("part") > _COUNTED_CHARS
    strings = F.explode(F.when(long, raw_pre_tokens("part")).otherwise(F.array("part"))).alias("raw")
    counted = parts.select(strings, long.alias("cut")).groupBy("raw", "cut").agg(F.count("*").alias("n"))
    pieces = F.when(F.col("cut"), F.array("raw")).otherwise(raw_pre_tokens("raw"))
    words = counted.select(F.explode(pieces).alias("raw"), "n").select(open_piece("raw").alias("word"), "n")
    return words.groupBy("word").agg(F.sum("n").alias("count"))


def numbered(pieces: list[tuple[str, float]], spark: SparkSession) -> DataFrame:
    """A vocabulary table from pieces in id order: special tokens first."""
    first = len(SPECIAL_TOKENS)
    columns = {
        "id": pa.array(range(first + len(pieces)), pa.int32()),
        "piece": [*SPECIAL_TOKENS, *(piece for piece, _ in pieces)],
        "score": [0.0] * first + [float(score) for _, score in pieces],
        "is_special": [True] * first + [False] * len(pieces),
    }
    return spark.createDataFrame(pa.table(columns), schemas.VOCAB)


def word_vocabulary(docs: DataFrame, *, size: int = VOCABULARY_SIZE, text="text") -> DataFrame:
    """The ``size`` most frequent words, special tokens included; ties in word order.

    A vocabulary small enough to be sent to the executors is numbered on the driver; a larger one stays
    distributed.
    """
    first = len(SPECIAL_TOKENS)
    top = top_rows(word_counts(docs, text=text), by="count", then="word", n=size - first)
    if size <= BROADCAST_PIECES:
        rows = [(r["word"], r["count"]) for r in top.collect()]
        return numbered(sorted(rows, key=lambda wc: (-wc[1], wc[0].encode())), docs.sparkSession)
    order = [F.desc("count"), F.col("word")]
    rows = number_rows(top, key="word", order=order, carry=["count"], out="id")
    plain = rows.select(
        (F.col("id") + first).cast("int").alias("id"), F.col("word").alias("piece"),
        F.col("count").cast("double").alias("score"), F.lit(False).alias("is_special"),
    )
    return numbered([], docs.sparkSession).unionByName(plain)


def save_vocabulary(vocab: DataFrame, path: str) -> DataFrame:
    """Store a vocabulary in id order; a small one becomes one file."""
    vocab.orderBy("id").write.mode("overwrite").parquet(path)
    return load_vocabulary(vocab.sparkSession, path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VOCAB).parquet(path)
