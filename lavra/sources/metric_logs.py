"""Readers of training metric logs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from lavra import schemas


def scan_metric_csv(spark: SparkSession, path: str) -> DataFrame:
    """A scalar series exported as CSV with ``Step`` and ``Value``."""
    return spark.read.schema(schemas.METRIC_CSV).option("header", True).csv(path)


def metric_tags(log: DataFrame) -> DataFrame:
    return log.select("tag").distinct()


def metric_series(log: DataFrame, tag: str, *, after_step: int | None = None) -> DataFrame:
    """Steps and values of one tag, optionally past a step; a tag that is missing gives no rows.

    ``warn_missing`` looks for the tag first and warns where it is not there.
    """
    test = F.col("tag") == tag
    if after_step is not None:
        test &= F.col("step") > after_step
    return log.where(test).select("run_id", "step", "value")


def warn_missing(log: DataFrame, tags: list[str]) -> list[str]:
    """Those of the tags that the log does not have, each with a warning. One row per tag comes back at most."""
    found = {r["tag"] for r in log.where(F.col("tag").isin(tags)).select("tag").distinct().collect()}
    missing = [t for t in tags if t not in found]
    for tag in missing:
        warnings.warn(f"tag {tag!r} is not in the log", stacklevel=2)
    return missing


def latest_run(log: DataFrame, *, parent: str = "parent") -> DataFrame:
    """Rows of the newest run under each parent; equal times go to the larger run id.

    The newest run is found by a partial aggregate; the rows come back by a semi-join on (parent, run).
    """
    newest = log.groupBy(parent).agg(
        F.max_by("run_id", F.struct("run_ts", "run_id")).alias("run_id")
    )
    return log.join(newest, [parent, "run_id"], "left_semi")
