"""Folders of text files of any number: listed and read by tasks, so that the driver holds none of their names."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from lavra.session import BATCH_BYTES, stage

# Names in one batch of a listing, and files that one task reads, about.
_NAMES = 10_000
_FILES = 4_096

_LISTED = "path string, is_folder boolean"
# What Java quotes in the path of a URI.
_QUOTED = re.compile(
    "[\\x00-\\x20\"#%<>?\\[\\\\\\]^`{|}\\x7f-\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
)


def _store(uri: str) -> fs.FileSystem:
    return fs.LocalFileSystem() if uri.startswith("file:") else fs.FileSystem.from_uri(uri)[0]


def _quoted(path: str) -> str:
    return _QUOTED.sub(lambda c: "".join(f"%{b:02X}" for b in c[0].encode()), path)


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, str, bool]]:
    """Name, path and whether it is a folder. Local folders are walked, of others the list of one is held."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir() or e.is_file():
                    yield e.name, e.path, e.is_dir()
        return
    for e in store.get_file_info(fs.FileSelector(folder)):
        if e.type in (fs.FileType.Directory, fs.FileType.File):
            yield e.base_name, e.path, e.type == fs.FileType.Directory


def _list(uri: str, suffix: str):
    """What lies in folders: folders, and files with the suffix."""

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([f for _, f in found], pa.bool_())], names=["path", "is_folder"])

    def listed(batches):
        store, found = _store(uri), []
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                for name, path, is_folder in _entries(store, folder):
                    if not _hidden(name) and (is_folder or name.endswith(suffix)):
                        found.append((path, is_folder))
                    if len(found) >= _NAMES:
                        yield rows(found)
                        found = []
        yield rows(found)

    return listed


def _read(uri: str, root: str, shown: str):
    """Path and bytes of each file; empty files have no row."""

    def rows(names, texts):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["file_path", "text"])

    def read(batches):
        store, names, texts, size = _store(uri), [], [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as file:
                    text = file.read()
                if not text:
                    continue
                names.append(shown + _quoted(path[len(root) :]))
                texts.append(text)
                size += len(text)
                if size >= BATCH_BYTES or len(names) >= _NAMES:
                    yield rows(names, texts)
                    names, texts, size = [], [], 0
        yield rows(names, texts)

    return read


def reachable(spark: SparkSession, folder: str, suffix: str) -> tuple[str, str, str] | None:
    """URI, path in its store, and path as Spark shows it, of a folder that tasks can list by themselves.

    None if it is a pattern, no folder, or in a store that only Spark reads, or if files may be compressed.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    if re.search(r"[*?\[\]{}\\]", folder) or not re.fullmatch(r"\.[\w.+-]+", suffix):
        return None
    if jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(jvm.org.apache.hadoop.fs.Path(f"x{suffix}")):
        return None
    path = jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(conf).makeQualified(path).toUri()
    uri, shown = whole.toASCIIString(), re.sub(r"\A(\w+):///", r"\1:/", whole.toString()).rstrip("/")
    try:
        root = whole.getPath() if uri.startswith("file:") else fs.FileSystem.from_uri(uri)[1]
        if _store(uri).get_file_info(root).type != fs.FileType.Directory:
            return None
    except (OSError, ValueError, NotImplementedError):
        return None
    return uri, root.rstrip("/"), shown


def scan(spark: SparkSession, uri: str, root: str, shown: str, suffix: str) -> DataFrame:
    """``file_path`` and ``text`` of all files below a folder, listed one level of folders at a time."""
    cores = spark.sparkContext.defaultParallelism
    level, folders, files = spark.createDataFrame([(root,)], "path string"), 1, []
    while folders:
        tasks = min(folders, 16 * cores)
        found = stage(level.repartition(tasks).mapInArrow(_list(uri, suffix), _LISTED), "listing")
        files.append(found.where("NOT is_folder").select("path"))
        level = found.where("is_folder").select("path")
        folders = level.count()
    paths = files[0]
    for more in files[1:]:
        paths = paths.unionByName(more)
    tasks = max(cores, -(-paths.count() // _FILES))
    texts = paths.repartition(tasks).mapInArrow(_read(uri, root, shown), "file_path string, text binary")
    return texts.select("file_path", F.col("text").cast("string").alias("text"))
