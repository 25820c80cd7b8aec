"""Exact cuts and row numbers without a global sort in one task.

A cut is found as a value: small histograms of the key, each zooming into the bucket that holds the
cut, give the key of the last wanted row. Taking the rows is then a plain filter on the key.
"""

from __future__ import annotations

import math
import struct
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lavra.operators.skew import may_hold
from lavra.session import stage

_BUCKETS = 4096
_SMALL = 50_000
BROADCAST_KEYS = 2_000_000
ONE_TASK_ROWS = 4_000_000


def key_columns(key) -> list[str]:
    """The names of a key of one or several columns."""
    return [key] if isinstance(key, str) else list(key)


def shuffle_key(key, seed: int) -> Column:
    """A seeded pseudo-random order over a unique key, the same in every run and partitioning.

    The key is a column, or the names of several; a null part differs from every text.
    """
    if isinstance(key, (str, Column)):
        text = (F.col(key) if isinstance(key, str) else key).cast("string")
    else:
        text = F.to_json(F.array(*[F.col(k).cast("string") for k in key]))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(text, F.lit("null"))).cast("binary"))


def require_unique(df: DataFrame, key) -> None:
    """Raise if a key stands in two rows. Only keys move, and one row comes back at most."""
    names = key_columns(key)
    again = df.groupBy(*names).agg(F.count("*").alias("_n")).where("_n > 1").limit(1).collect()
    if again:
        raise ValueError(f"key {names} is not unique: {again[0]}")


def _hash_histogram(hashes: DataFrame, prefix: str) -> list[tuple[str, int]]:
    at = len(prefix)
    digits = F.substring("h", at + 1, 3).alias("d")
    rows = hashes.where(F.col("h").startswith(prefix)).groupBy(digits).count().collect()
    return sorted((r["d"], r["count"]) for r in rows)


def shuffled_cutoff(df: DataFrame, key: str, seed: int, share) -> str | None:
    """Largest shuffle key among the first rows of the seeded order; ``share`` maps a total to a count.

    Each pass reads the key column only and returns at most 4096 counts.
    """
    hashes = df.select(shuffle_key(key, seed).alias("h"))
    prefix, left = "", None
    while True:
        histogram = _hash_histogram(hashes, prefix)
        if left is None:
            left = share(sum(n for _, n in histogram))
            if left <= 0:
                return None
        for digits, n in histogram:
            if left <= n:
                break
            left -= n
        prefix += digits
        if n <= _SMALL or len(prefix) >= 30:
            edge = hashes.where(F.col("h").startswith(prefix)).orderBy("h").limit(left)
            return edge.agg(F.max("h")).first()[0]


def train_test_split(
    df: DataFrame, *, key="doc_id", test_size: float = 0.1, seed: int = 42, keys: DataFrame | None = None
) -> DataFrame:
    """Add ``split``: exactly ceil(test_size * n) rows are test, the rest train.

    The key is one column or several, such as source and id; a repeated key raises. The cut is found in a few passes over the keys; where computing ``df`` is dear, pass its keys as a
    stored table. The rows themselves are read once and never move.
    """
    keys = df if keys is None else keys
    require_unique(keys, key)
    cut = shuffled_cutoff(keys, key, seed, lambda n: math.ceil(test_size * n))
    if cut is None:
        return df.withColumn("split", F.lit("train"))
    is_test = shuffle_key(key, seed) <= cut
    return df.withColumn("split", F.when(is_test, "test").otherwise("train"))


def shuffled_fraction(
    df: DataFrame, *, key="doc_id", fraction: float, seed: int = 42, keys: DataFrame | None = None
) -> DataFrame:
    """Exactly floor(fraction * n) rows in seeded random choice."""
    keys = df if keys is None else keys
    require_unique(keys, key)
    cut = shuffled_cutoff(keys, key, seed, lambda n: math.floor(fraction * n))
    return df.where(F.lit(False)) if cut is None else df.where(shuffle_key(key, seed) <= cut)


def ordered_cutoff(df: DataFrame, key: str, share, *, descending: bool = False):
    """Key of the last of the first rows in key order, with the rows before it.

    The key may be an integer, text or bytes (in byte order), a date, a timestamp, a float or double (NaN
    last) or a decimal of up to 18 digits. Nulls are left out. Returns ``(cutoff, rows strictly before the
    cutoff, wanted rows)``, with no number of rows before when all rows are wanted, or None when none is.
    """
    column, kind = F.col(key), df.select(key).schema[0].dataType
    known = df.where(column.isNotNull())
    if isinstance(kind, T.IntegralType):
        return _integer_cutoff(known.select(column.cast("long").alias("k")), share, descending)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        cut = _byte_cutoff(known.select(column.cast("binary").alias("k")), share, descending)
        return cut if cut is None or isinstance(kind, T.BinaryType) else (cut[0].decode(), *cut[1:])
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _float_cutoff(known.select(column.cast("double").alias("k")), share, descending)
    if isinstance(kind, T.DateType):
        whole, back = F.unix_date(column).cast("long"), lambda n: F.date_from_unix_date(F.lit(n).cast("int"))
    elif isinstance(kind, T.TimestampType):
        whole, back = F.unix_micros(column), lambda n: F.timestamp_micros(F.lit(n))
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        whole, back = (column * F.lit(10**kind.scale)).cast("long"), lambda n: F.lit(Decimal(n).scaleb(-kind.scale))
    else:
        raise TypeError(f"no order cut on a key of type {kind.simpleString()}")
    cut = _integer_cutoff(known.select(whole.alias("k")), share, descending)
    return cut if cut is None else (back(cut[0]), *cut[1:])


def _walk(counts, before: int, wanted: int):
    """The part in which the last wanted row lies, and the rows before that part."""
    for part, n in counts:
        if before + n >= wanted:
            break
        before += n
    return part, before


def _byte_cutoff(keys: DataFrame, share, descending: bool):
    """Cut on byte strings: what all keys left share is passed over, then two bytes at a time are counted."""
    total = keys.count()
    wanted = min(share(total), total)
    if wanted <= 0:
        return None
    before = 0
    while True:
        low, high = (bytes(x) for x in keys.agg(F.min("k"), F.max("k")).first())
        if low == high or wanted == total:
            return (low if descending else high), (None if wanted == total else before), wanted
        same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        counts = [(bytes(r["b"]), r["count"]) for r in keys.groupBy(F.substring("k", same + 1, 2).alias("b")).count().collect()]
        part, before = _walk(sorted(counts, reverse=descending), before, wanted)
        keys = keys.where(F.substring("k", 1, same + 2) == F.lit(low[:same] + part))


def _order(x: float) -> int:
    """An integer that orders doubles; both zeros are 0."""
    (bits,) = struct.unpack("<q", struct.pack("<d", abs(x)))
    return -bits if x < 0 else bits


def _double(order: int) -> float:
    (x,) = struct.unpack("<d", struct.pack("<q", abs(order)))
    return -x if order < 0 else x


_EDGES = 64


def _float_cutoff(keys: DataFrame, share, descending: bool):
    """Cut on doubles: the range is halved by edges that have as many doubles between them."""
    nan, total = keys.agg(F.count_if(F.isnan("k")), F.count("*")).first()
    wanted = min(share(total), total)
    if wanted <= 0:
        return None
    if nan and (wanted <= nan if descending else wanted > total - nan):
        return float("nan"), (None if wanted == total else 0 if descending else total - nan), wanted
    keys, before = keys.where(~F.isnan("k")), nan if descending else 0
    while True:
        low, high = keys.agg(F.min("k"), F.max("k")).first()
        if low == high or wanted == total:
            return (low if descending else high) + 0.0, (None if wanted == total else before), wanted
        first, last = _order(low), _order(high)
        edges = [_double(first + (last - first) * i // _EDGES) for i in range(1, _EDGES)] + [high]
        edges = sorted({e for e in edges if e > low})
        bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("k")))
        counts = [(r["b"], r["count"]) for r in keys.groupBy(bucket.alias("b")).count().collect()]
        part, before = _walk(sorted(counts, reverse=descending), before, wanted)
        if part:
            keys = keys.where(F.col("k") >= edges[part - 1])
        if part < len(edges):
            keys = keys.where(F.col("k") < edges[part])


def _integer_cutoff(keys: DataFrame, share, descending: bool):
    """Cut on longs: the value range is cut into 4096 parts, then the part with the cut again, until it is one value."""
    low, high, total = keys.agg(F.min("k"), F.max("k"), F.count("*")).first()
    wanted = min(share(total), total)
    if wanted <= 0:
        return None
    if wanted == total:
        return (low if descending else high), None, wanted
    before = 0
    while low < high:
        width = -(-(high - low + 1) // _BUCKETS)
        # The whole range of a long is wider than a long.
        wide = high - low >= 1 << 62
        k, edge = (c.cast("decimal(38,0)") if wide else c for c in (F.col("k"), F.lit(high if descending else low)))
        distance = edge - k if descending else k - edge
        if wide:
            distance = (distance - F.pmod(distance, F.lit(width).cast("decimal(38,0)"))) / F.lit(width)
            bucket = F.round(distance).cast("long")
        else:
            bucket = F.floor(distance / F.lit(width)) if width > 1 else distance
        inside = keys.where(F.col("k").between(low, high))
        for part, n in sorted(
            (r["b"], r["count"]) for r in inside.groupBy(bucket.alias("b")).count().collect()
        ):
            if before + n >= wanted:
                break
            before += n
        part, edges = int(part), (low, high)
        if descending:
            high = edges[1] - part * width
            low = max(edges[0], high - width + 1)
        else:
            low = edges[0] + part * width
            high = min(edges[1], low + width - 1)
    return low, before, wanted


def head_percent(df: DataFrame, *, key: str = "doc_id", percent: float, rounding="closest") -> DataFrame:
    """The first ``percent`` of the rows in key order. The result is a filter that reaches the scan.

    Keys may be of any type that ``ordered_cutoff`` takes. Rows that share the last key all come.
    """
    take = (lambda n: math.floor(n * percent / 100 + 0.5)) if rounding == "closest" else (
        lambda n: math.floor(n * percent / 100)
    )
    cut = ordered_cutoff(df, key, take)
    return df.where(F.lit(False)) if cut is None else df.where(F.col(key) <= cut[0])


def top_rows(df: DataFrame, *, by: str, then: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest ``by``, ties by ascending ``then``, nulls first.

    While the best rows of all tasks together fit one task, Spark's own top-k does it in one pass.
    Beyond that ``df`` is stored, its cutoff found, and all rows above it are taken by filter; of the rows
    on the cutoff the first are found by a cutoff of ``then``. Only rows equal in both are limited.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if tasks * n <= ONE_TASK_ROWS:
        return df.orderBy(F.desc(by), then).limit(n)
    df = stage(df, "ranked")
    cut = ordered_cutoff(df, by, lambda _: n, descending=True)
    if cut is None:
        return df.where(F.lit(False))
    cutoff, before, wanted = cut
    if before is None:
        return df
    above = df.where(F.col(by) > cutoff)
    ties = df.where(F.col(by) == cutoff)
    left = wanted - before
    if ties.count() == left:
        return df.where(F.col(by) >= cutoff)
    unset = ties.where(F.col(then).isNull())
    unset_rows = unset.count()
    if unset_rows >= left:
        return above.unionByName(unset.limit(left))
    last, earlier, _ = ordered_cutoff(ties, then, lambda _: left - unset_rows)
    equal = ties.where(F.col(then) == last).limit(left - unset_rows - (earlier or 0))
    return above.unionByName(ties.where(F.col(then).isNull() | (F.col(then) < last))).unionByName(equal)


def _numbered(df: DataFrame, columns: list[str], order: list, out: str) -> tuple[DataFrame, int]:
    place = F.monotonically_increasing_id()
    ordered = df.select(*columns).orderBy(*order).select(*columns, place.alias("_at"))
    ordered = stage(ordered, "row-places")
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in ordered.groupBy(part).count().collect())
    starts, seen = [], 0
    for number, size in sizes:
        starts.append((number, seen))
        seen += size
    table = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = (
        ordered.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .select(*columns, (F.col("_start") + inside).alias(out))
    )
    return rows, seen


def number_rows(df: DataFrame, *, key: str, order: list | None = None, carry=(), out="row_no") -> DataFrame:
    """0-based row number in key order, or in a given total order, as a table of (key, carried, number).

    A range sort gives each task one stretch of keys. Each row keeps its task and its place there in a
    stored table, so that a lost executor cannot change the stretches, and each stretch gets the count
    of rows before it. Only one count per task is gathered.
    """
    return _numbered(df, [key, *carry], order or [key], out)[0]


def numbered_rows(df: DataFrame, *, key: str) -> tuple[DataFrame, int]:
    """The table of ``number_rows`` in key order, and how many rows it has."""
    return _numbered(df, [key], [key], "row_no")


def every_kth(df: DataFrame, *, key: str = "doc_id", ratio: float) -> DataFrame:
    """Every int(1/ratio)-th row in key order, from the first; all rows unless 0 < ratio < 1.

    Only keys are sorted and numbered; the rows come back through a semi-join on the chosen keys. Their
    number is known beforehand: few are sent to every task, so the rows stay where they are; many meet
    the rows in a shuffle, after a Bloom filter of them has left out nearly all rows that are not chosen.
    """
    if not 0 < ratio < 1:
        return df
    step = int(1 / ratio)
    numbered, total = _numbered(df, [key], [key], "row_no")
    chosen = numbered.where(F.col("row_no") % step == 0).select(key)
    if total // step <= BROADCAST_KEYS:
        return df.join(F.broadcast(chosen), key, "left_semi")
    return may_hold(df, chosen, key, total // step).join(chosen, key, "left_semi")
