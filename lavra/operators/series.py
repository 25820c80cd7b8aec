"""Metric series: smoothing, splitting and overlaying."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import DataFrame, Window, functions as F

_CHUNK = 1 << 16


def smooth(
    log: DataFrame, *, smoothing: float = 0.6, by=("run_id", "tag"), step="step", value="value",
    out="smoothed", chunk: int = _CHUNK,
) -> DataFrame:
    """Exponential moving average with weights normalised by their sum.

    A null value weighs nothing but takes its place in the row of weights, and shows the average so far;
    before the first value the average is null. A series is cut into chunks of steps, which number its
    rows, and then into stretches of rows so long that all before the last stretch weighs nothing. Inside
    a stretch the weighted sums are running sums of values scaled by their place, so the cost does not
    depend on the smoothing.
    """
    if not 0 < smoothing < 1:
        raise ValueError("smoothing must lie between 0 and 1")
    # smoothing ** -stretch stays far from the limits of a double, smoothing ** stretch is nothing.
    stretch = max(1, math.floor(math.log(1e-140) / math.log(smoothing)))
    cut = log.withColumn("_chunk", F.coalesce(F.floor(F.col(step) / chunk), F.lit(0)))
    inside = Window.partitionBy(*by, "_chunk").orderBy(step)
    local = cut.withColumn("_rn", F.row_number().over(inside))
    # One row per chunk. This pass has the same key, so Spark reuses the exchange.
    sizes = local.groupBy(*by, "_chunk").agg(F.max("_rn").cast("long").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_chunk", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_seen"))
    number = F.col("_seen") + F.col("_rn") - 1
    placed = _null_safe(local, sizes, [*by, "_chunk"]).select(
        *log.columns, F.floor(number / stretch).alias("_stretch"), (number % stretch).cast("int").alias("_at")
    )
    up = F.pow(F.lit(smoothing), -F.col("_at"))
    down = F.pow(F.lit(smoothing), F.col("_at"))
    given = F.col(value).cast("double")
    running = Window.partitionBy(*by, "_stretch").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_sum", F.sum(F.coalesce(given, F.lit(0.0)) * up).over(running) * down).withColumn(
        "_weight", F.sum(F.when(given.isNotNull(), up).otherwise(0.0)).over(running) * down
    )
    ends = summed.groupBy(*by, (F.col("_stretch") + 1).alias("_stretch")).agg(
        F.max_by("_sum", "_at").alias("_sum0"), F.max_by("_weight", "_at").alias("_weight0")
    )
    joined = _null_safe(summed, ends, [*by, "_stretch"], "left")
    carry = down * smoothing
    total = F.col("_sum") + carry * F.coalesce("_sum0", F.lit(0.0))
    weight = F.col("_weight") + carry * F.coalesce("_weight0", F.lit(0.0))
    return joined.select(*log.columns, F.try_divide(total, weight).alias(out))


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how="inner") -> DataFrame:
    """A join whose keys may be null; the right side's keys leave."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    test = functools.reduce(operator.and_, [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in on])
    return left.join(renamed, test, how).drop(*[f"_right_{c}" for c in on])


def wide_series(log: DataFrame, tags: list[str], *, by=("run_id", "step")) -> DataFrame:
    """One column per named tag, one row per run and step that has any of them."""
    picked = log.where(F.col("tag").isin(tags))
    return picked.groupBy(*by).pivot("tag", tags).agg(F.max("value"))


def overlay(log: DataFrame, left: str, right: str, *, by=("run_id", "step")) -> DataFrame:
    """Two tags side by side on their steps; a step that only one of them has stays, with a null."""
    def one(tag):
        return log.where(F.col("tag") == tag).select(*by, F.col("value").alias(tag))

    return one(left).join(one(right), list(by), "full")
