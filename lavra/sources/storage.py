"""Writing stages and using stored ones again."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F


def save(df: DataFrame, path: str, *, mode: str = "errorifexists", partition_by=None) -> DataFrame:
    """Write a stage, one folder per split if the table has splits, and return the stored table.

    The table is not shuffled before the write: each task writes at most one file per split.
    """
    if partition_by is None:
        partition_by = ["split"] if "split" in df.columns else []
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at ``path`` (on any file system Spark knows)."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


_RECORD = "_parameters.json"


def _record_path(spark: SparkSession, path: str):
    file = spark._jvm.org.apache.hadoop.fs.Path(path, _RECORD)
    return file, file.getFileSystem(spark._jsc.hadoopConfiguration())


def _plain(parameters: dict) -> str:
    return json.dumps(parameters, sort_keys=True, default=repr)


def write_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    """Keep beside a stored stage what it was built with."""
    file, store = _record_path(spark, path)
    out = store.create(file, True)
    out.write(bytearray(_plain(parameters).encode()))
    out.close()


def _read_parameters(spark: SparkSession, path: str) -> str | None:
    file, store = _record_path(spark, path)
    if not store.exists(file):
        return None
    stream = store.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def same_parameters(spark: SparkSession, path: str, parameters: dict, *, ignore=()) -> bool:
    """Whether a stored stage was built with these parameters, but for those ignored; one without a record was not."""
    kept = _read_parameters(spark, path)
    if kept is None:
        return False
    wanted, found = json.loads(_plain(parameters)), json.loads(kept)
    for name in ignore:
        wanted.pop(name, None), found.pop(name, None)
    return wanted == found


def identity(df: DataFrame) -> str:
    """What a table is made of, as a digest: its plan, and the path, length and time of every file it reads.

    Files are listed by Spark and added up there; none is opened. A table that holds rows of the session
    itself, which have no files, is told apart by a sum over its rows instead.
    """
    spark = df.sparkSession
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().analyzed().canonicalized().toString())
    parts = [plan, json.dumps(df.dtypes)]
    files = [unquote(f) for f in df.inputFiles()]
    if files:
        found = spark.read.format("binaryFile").load(files).select("path", "length", F.unix_micros("modificationTime").alias("at"))
        parts.append(str(_summed(found)))
    if not files or re.search(r"LogicalRDD|LocalRelation|InMemoryRelation", plan):
        parts.append(str(_summed(df)))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def _summed(rows: DataFrame) -> tuple:
    """Count and sum of hashes of all rows, in any order."""
    hashed = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"ignoreNullFields": "false"}))
    return tuple(rows.agg(F.count("*"), F.sum(hashed.cast("decimal(38,0)"))).first())


def reusable(spark: SparkSession, path: str, parameters: dict, *, ignore=()) -> bool:
    """Whether a finished stage can be used again. One built otherwise raises; it is not overwritten unasked."""
    if not is_complete(spark, path):
        return False
    if not same_parameters(spark, path, parameters, ignore=ignore):
        raise ValueError(f"{path} was built with other parameters or sources; pass rebuild=True to replace it")
    return True


def materialize(
    spark: SparkSession, build: Callable[[], DataFrame], path: str, *, parameters: dict | None = None, rebuild: bool = False, ignore=()
) -> DataFrame:
    """The stored table if it is complete and was built with the same parameters, else build and store it."""
    parameters = parameters or {}
    if not rebuild and reusable(spark, path, parameters, ignore=ignore):
        return spark.read.parquet(path)
    stored = save(build(), path, mode="overwrite")
    write_parameters(spark, path, parameters)
    return stored
