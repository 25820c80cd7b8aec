"""Session-level helpers: scratch tables in the shared folder, and input spread."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F


_local_roots: dict[str, str] = {}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package's code to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="lavra-"), "lavra.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(os.path.join(home, "lavra")):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, home))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="lavra-")
    return _local_roots[app]


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/lavra/{spark.sparkContext.applicationId}"


def new_scratch(spark: SparkSession, label: str) -> str:
    """A path not used before, under this application's part of the shared folder."""
    return f"{_own_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Results that still read them must be written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Options for tables whose rows are large values each: pages and row groups end after few of them.
PACKED = {
    "parquet.block.size": 16 << 20,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
    "compression": "zstd",
}


def stage(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` once, with the writer's ``options``, and go on from the written table.

    Cuts the lineage and survives the loss of executors, since the files lie in the shared folder.
    """
    path = new_scratch(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SPREAD_BYTES = 1 << 30


def spread(scan: DataFrame) -> DataFrame:
    """Give each core work when a small input has fewer splits than the cluster has cores.

    For scans only: asking for the splits of a plan with shuffles would run them. Inputs over one
    gigabyte, or with enough splits, pass untouched, so large tables are never shuffled here.
    """
    run = scan._jdf.queryExecution()
    size = int(run.optimizedPlan().stats().sizeInBytes())
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if size > SPREAD_BYTES or run.toRdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Python workers get texts in batches of bounded bytes; by default only rows are counted."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fence(df: DataFrame, *columns, keep=None) -> DataFrame:
    """Compute ``columns`` exactly once and keep later steps from inlining them.

    Catalyst merges stacked projections, so an array used by several expressions, or inside a
    lambda, would be evaluated again for every use. A one-row generator stops the merge.
    """
    keep = df.columns if keep is None else keep
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def fresh(name: str, taken) -> str:
    """``name``, with underscores before it until no column of ``taken`` has it."""
    seen = {c.lower() for c in taken}
    while name.lower() in seen:
        name = f"_{name}"
    return name


def as_text(column):
    """An array column as one space-separated string."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(column.cast("array<string>"), " ")
