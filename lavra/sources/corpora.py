"""Readers of text corpora and task sets. All schemas are declared; nothing is inferred."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lavra import schemas
from lavra.sources import text_files


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_documents(spark: SparkSession, path: str, *, lang: str | None = None) -> DataFrame:
    """One row per page or document; the language test reaches the parquet scan."""
    docs = spark.read.parquet(path)
    return docs if lang is None else docs.where(F.col("lang") == lang)


def scan_nested(spark: SparkSession, path: str) -> DataFrame:
    """A corpus whose text is a list of paragraphs, each a list of strings."""
    return spark.read.schema(schemas.NESTED_DOCS).parquet(path)


def scan_json_lines(spark: SparkSession, glob: str, schema: str = schemas.RAW_DOCS) -> DataFrame:
    """JSON lines, plain or compressed, by path or glob."""
    return spark.read.schema(schema).json(glob)


def scan_text_files(spark: SparkSession, folder: str, *, suffix: str = ".txt") -> DataFrame:
    """One row per text file, with its path; other files are skipped.

    Tasks list the folder and read it. The driver lists what only Spark's readers reach (``text_files.reachable``).
    """
    known = text_files.reachable(spark, folder, suffix)
    if known is not None:
        return text_files.scan(spark, *known, suffix)
    files = (
        spark.read.option("pathGlobFilter", f"*{suffix}")
        .option("recursiveFileLookup", True)
        .text(folder, wholetext=True)
    )
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))


def scan_tagged(spark: SparkSession, path: str, *, split: str | None = None) -> DataFrame:
    """Word-tagged sentences; a split is a partition filter."""
    return _one_split(spark.read.schema(schemas.TAGGED_WORDS).parquet(path), split)


def scan_pairs(spark: SparkSession, path: str, *, split: str | None = None) -> DataFrame:
    """Sentence pairs with a score and a class; a split is a partition filter."""
    return _one_split(spark.read.schema(schemas.PAIRS).parquet(path), split)


def _one_split(df: DataFrame, split: str | None) -> DataFrame:
    return df if split is None else df.where(F.col("split") == split)


def reload(spark: SparkSession, path: str, *, split: str | None = "train") -> DataFrame:
    """A stored table: one split if the table has splits, else all of it. A missing path raises."""
    stored = spark.read.parquet(path)
    return _one_split(stored, split if "split" in stored.columns else None)


def union_sources(sources: list[DataFrame], columns=("doc_id", "text")) -> DataFrame:
    """Sources one after the other, reduced to the named columns; duplicates stay."""
    return reduce(DataFrame.unionByName, [s.select(*columns) for s in sources])
