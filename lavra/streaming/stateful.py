"""Streams that remember: each key once, running totals, and a split that stays as it is for arrivals.

State lies in Spark's state store beside the stream's progress, so a restart goes on where it stopped. The
number of its partitions is that of ``spark.sql.shuffle.partitions`` at the first start; for many keys set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, which keeps them off the heap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lavra.operators.cuts import key_columns, shuffle_key

# Groups of running totals are dealt to this many states each, so that a group of most rows is no one task's.
PARTS = 64


def each_once(arriving: DataFrame, key="doc_id", *, time: str | None = None, within: str | None = None) -> DataFrame:
    """The first arrival of each key, over all triggers and restarts; works on a table too.

    Only keys are kept, all of them; null is a key like others. Which of several rows of one key in one
    trigger stays is open. With ``time``, a timestamp column, and ``within``, a span such as ``"2 days"``,
    keys leave the state that long after their first row, so the state stays bounded; a repetition may then
    be found only within that span. Select narrow rows first: they are shuffled by key.
    """
    names = key_columns(key)
    if (time is None) != (within is None):
        raise ValueError("time and within go together")
    if time is None or not arriving.isStreaming:
        return arriving.dropDuplicates(names)
    return arriving.withWatermark(time, within).dropDuplicatesWithinWatermark(names)


def arrival_split(key, *, share: float, seed: int, small="test", large="train") -> Column:
    """``small`` for about ``share`` of all keys, else ``large``; an arrival never moves an earlier row.

    It depends on key and seed alone. Exact sizes need the whole table: see ``cuts``.
    """
    if not 0 < share < 1:
        raise ValueError(f"share must lie between 0 and 1: {share}")
    below = f"{int(share * 2**32):08x}"
    return F.when(F.substring(shuffle_key(key, seed), 1, 8) < below, small).otherwise(large)


def running_totals(arriving: DataFrame, *, by: str, sums: list[str], spread_by: str) -> DataFrame:
    """After each trigger, rows and sums so far of every group that got rows, for ``latest_totals``.

    A group is dealt to ``PARTS`` states by a hash of ``spread_by``, and rows reach them in Arrow batches of
    three narrow columns. Null values add nothing; null is a group like others.
    """
    part = F.pmod(F.xxhash64(spread_by), F.lit(PARTS)).cast("int")
    rows = arriving.select(by, part.alias("_part"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in sums])
    kind = dict(rows.dtypes)[by]
    columns = ["_rows", *sums]

    def add(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        totals = list(state.get) if state.exists else [0] * len(columns)
        for batch in batches:
            totals = [t + int(n) for t, n in zip(totals, [len(batch), *(batch[c].sum() for c in sums)])]
        state.update(tuple(totals))
        yield pd.DataFrame([(*key, *totals)], columns=[by, "_part", *columns])

    totals = ", ".join(f"`{c}` long" for c in columns)
    return rows.groupBy(by, "_part").applyInPandasWithState(
        add, f"`{by}` {kind}, _part int, {totals}", totals, "append", GroupStateTimeout.NoTimeout
    )


def latest_totals(written: DataFrame, *, by: str, sums: list[str], count="n_rows") -> DataFrame:
    """Rows and sums of each group from what ``running_totals`` has written: a part's newest row has the most rows."""
    newest = written.groupBy(by, "_part").agg(F.max(F.struct("_rows", *sums)).alias("_newest"))
    return newest.groupBy(by).agg(
        F.sum("_newest._rows").alias(count), *[F.sum(f"_newest.`{c}`").alias(c) for c in sums]
    )
