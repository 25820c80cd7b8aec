"""The given tables as the registered queries read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lavra.session import bound_batches, spread
from lavra.sources import corpora


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; a small one in few splits is dealt to all cores. The library's readers never do that."""
    bound_batches(spark)
    return spread(corpora.table(spark, folder, name))
