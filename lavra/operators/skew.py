"""Joins that stay balanced and small: heavy keys apart, and a Bloom filter before a semi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lavra.session import stage

# A key on more than this share of the rows is heavy; so there are at most a thousand.
HEAVY_KEYS = 1_000
_TRACKED = 10_000

# The filter has 16 bits for each key, in at most 2^23 words of 64 bits (64 MB), one row per segment of words.
SEGMENT = 1 << 10
MOST_WORDS = 1 << 23


def heavy_keys(rows: DataFrame, key: str) -> list:
    """The keys that stand on more than one in ``HEAVY_KEYS`` rows, by a mergeable sketch over all rows.

    A key that the sketch takes for heavy by mistake, or misses at the bound, costs time only.
    """
    found = rows.where(F.col(key).isNotNull()).agg(
        F.call_function("approx_top_k", F.col(key), F.lit(HEAVY_KEYS), F.lit(_TRACKED)).alias("top"), F.count("*").alias("n")
    ).first()
    return sorted(r["item"] for r in found["top"] or () if r["count"] * HEAVY_KEYS > found["n"])


def heavy_join(rows: DataFrame, table: DataFrame, key: str, how: str) -> DataFrame:
    """Join ``rows``, which a few keys may fill, with a table that has each key at most once.

    Rows of heavy keys stay where they are and meet their part of the table, a thousand rows at most, sent
    to every task; the others are joined on the key as usual. Null keys stay where they are too. ``rows``
    is read three times, so it should be a stored table or cheap to make from one.
    """
    heavy = heavy_keys(rows, key)
    if not heavy:
        return rows.where(F.col(key).isNotNull()).join(table, key, how).unionByName(
            rows.where(F.col(key).isNull()).join(F.broadcast(table.limit(0)), key, how)
        )
    here = F.col(key).isin(heavy)
    hot = rows.where(F.col(key).isNull() | here).join(F.broadcast(table.where(here)), key, how)
    return hot.unionByName(rows.where(~here).join(table, key, how))


def _bit(hashed: Column, skip: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, skip).bitwiseAND(63).cast("int"))


def _place(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a key in the filter, and the bits it sets there."""
    h = F.xxhash64(key)
    return h.bitwiseAND(words - 1), _bit(h, 30).bitwiseOR(_bit(h, 36)).bitwiseOR(_bit(h, 42)).bitwiseOR(_bit(h, 48))


def _filter(rows: DataFrame, keys: DataFrame, key: str, n: int) -> tuple[DataFrame, Column]:
    """The stored filter of ``keys``, at most 64 MB, and the condition that joins ``rows`` with it."""
    words = SEGMENT
    while words * 4 < n and words < MOST_WORDS:
        words *= 2
    place, bits = _place(F.col(key), words)
    unset = keys.sparkSession.range(words).select(F.col("id").alias("place"), F.lit(0).cast("long").alias("bits"))
    full = unset.unionByName(keys.select(place.alias("place"), bits.alias("bits"))).groupBy("place").agg(F.bit_or("bits").alias("bits"))
    listed = F.sort_array(F.collect_list(F.struct("place", "bits")))
    fresh = "_filter"
    while any(c.startswith(fresh) for c in rows.columns):
        fresh = f"_{fresh}"
    segments = full.groupBy(F.floor(F.col("place") / SEGMENT).alias(f"{fresh}_segment")).agg(listed.alias("w"))
    segments = stage(segments.select(f"{fresh}_segment", F.col("w.bits").alias(f"{fresh}_words")), "filter")
    at = F.get(F.col(f"{fresh}_words"), place.bitwiseAND(SEGMENT - 1).cast("int"))
    held = (F.floor(place / SEGMENT) == F.col(f"{fresh}_segment")) & (at.bitwiseAND(bits) == bits)
    return F.broadcast(segments), held


def may_hold(rows: DataFrame, keys: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose key may be among ``keys``, ``n`` in number: all that are, and few others. No row moves.

    The filter is built by partial aggregates. Beyond some 33 million keys it lets more rows through.
    """
    return rows.join(*_filter(rows, keys, key, n), "left_semi")


def split_by_filter(rows: DataFrame, keys: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``may_hold``, and all others, whose key is surely not among ``keys`` or is null."""
    found = _filter(rows, keys, key, n)
    return rows.join(*found, "left_semi"), rows.join(*found, "left_anti")
