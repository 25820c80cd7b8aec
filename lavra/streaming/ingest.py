"""Curation of files as they arrive. The same column logic as in batch; no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lavra import schemas
from lavra.functions.stopwords import STOPWORDS
from lavra.operators.filters import apply_rule
from lavra.operators.measures import measure_documents


def read_arriving(
    spark: SparkSession, folder: str, *, schema=schemas.RAW_DOCS, format="parquet", files_per_trigger=None
) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.format(format).schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def curate(docs: DataFrame, *, rule="phase2", min_words=100, stopwords=STOPWORDS) -> DataFrame:
    """Measure and filter; works on a stream and on a table alike."""
    return apply_rule(measure_documents(docs, min_words=min_words, stopwords=stopwords), rule)


def write_new(stream: DataFrame, path: str, checkpoint: str):
    """Append all files not seen before to a table, then stop. Restarts go on from the checkpoint."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
