"""Scalar event logs as a Spark data source, ``spark.read.format("event_log")`` and ``df.write``.

A log file is a sequence of records, each its length, a masked CRC-32C of the length, the bytes, and a masked
CRC-32C of the bytes; the bytes are an event message in protocol-buffer wire format, with the scalars of one
step. Files lie in one folder per run. Reading streams through each file in one task; writing makes one file
per run and task. Any file system that ``pyarrow.fs`` knows will do.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "parent string, run_id string, run_ts timestamp, tag string, step long, value double"
_ARROW = pa.schema(
    [("parent", pa.string()), ("run_id", pa.string()), ("run_ts", pa.timestamp("us", "UTC")), ("tag", pa.string()), ("step", pa.int64()), ("value", pa.float64())]
)
ROWS = 10_000
READ_BYTES = 1 << 20
TASK_BYTES = 64 << 20

# Fixed values of the format: the names files have, the polynomial, the mask, field numbers, and the version string.
NAME = "tfevents"
PREFIX = "events.out.tfevents"
_POLYNOMIAL = 0x82F63B78
_MASK = 0xA282EAD8
WALL_TIME, STEP, VERSION, SUMMARY = 1, 2, 3, 5
VALUE, TAG, SIMPLE = 1, 1, 2
_VERSION = b"brain.Event:2"


def _table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (_POLYNOMIAL if value & 1 else 0)
        out.append(value)
    return out


_BYTE = _table()


def crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc = _BYTE[(crc ^ byte) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


class Damaged(ValueError):
    """A record that is cut short or fails its checksum."""


def records(stream, verify: bool = True) -> Iterator[bytes]:
    """The records of a file, read in blocks. What follows a damaged record can't be trusted, so it raises there."""
    held, at = b"", 0

    def take(n: int) -> bytes:
        nonlocal held, at
        if len(held) - at < n:
            parts, size = [held[at:]], len(held) - at
            while size < n:
                more = stream.read(max(READ_BYTES, min(n - size, 64 * READ_BYTES)))
                if not more:
                    break
                parts.append(more)
                size += len(more)
            held, at = b"".join(parts), 0
        out = held[at : at + n]
        at += len(out)
        return out

    while head := take(12):
        if len(head) < 12 or (verify and masked(head[:8]) != struct.unpack("<I", head[8:])[0]):
            raise Damaged("length")
        (size,) = struct.unpack("<Q", head[:8])
        data = take(size + 4)
        if len(data) < size + 4 or (verify and masked(data[:-4]) != struct.unpack("<I", data[-4:])[0]):
            raise Damaged("record")
        yield data[:-4]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 127) << shift
        at += 1
        if byte < 128:
            return out, at
        shift += 7


def message(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a message; numbers of fixed width come as their bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind not in (1, 2, 5):
                raise Damaged("wire type")
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
            if at > len(data):
                raise Damaged("field")
        yield key >> 3, value


def scalars(event: bytes) -> Iterator[tuple[float, int, str, float]]:
    """Wall time, step, tag and value of each scalar of an event; other summaries are passed over."""
    wall, step, found = 0.0, 0, []
    for number, value in message(event):
        if number == WALL_TIME:
            (wall,) = struct.unpack("<d", value)
        elif number == STEP:
            step = value - (1 << 64) if value >= 1 << 63 else value
        elif number == SUMMARY:
            for inner, one in message(value):
                if inner == VALUE:
                    fields = dict(message(one))
                    if SIMPLE in fields:
                        found.append((fields.get(TAG, b"").decode("utf-8", "replace"), struct.unpack("<f", fields[SIMPLE])[0]))
    for tag, value in found:
        yield wall, step, tag, value


def _packed(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _packed(number << 3 | 2) + _packed(len(data)) + data


def event(wall: float, *, step: int = 0, tag: str | None = None, value: float = 0.0) -> bytes:
    """A scalar's event, or without a tag the one that begins a file."""
    head = _packed(WALL_TIME << 3 | 1) + struct.pack("<d", wall)
    if tag is None:
        return head + _field(VERSION, _VERSION)
    one = _field(TAG, tag.encode()) + _packed(SIMPLE << 3 | 5) + struct.pack("<f", value)
    return head + _packed(STEP << 3) + _packed(step) + _field(SUMMARY, _field(VALUE, one))


def record(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(size)) + data + struct.pack("<I", masked(data))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file://") else path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.verify = str(options.get("verify", "true")).lower() == "true"
        self.strict = str(options.get("mode", "dropTail")).lower() == "failfast"

    def partitions(self) -> list[_Files]:
        """Files, small ones together; a file is never split, as records can only be found from its start."""
        store, root = _opened(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [_Files([root])]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and NAME in f.base_name and not f.base_name.startswith((".", "_")))
        out, size = [], TASK_BYTES
        for path, more in files:
            if size + more > TASK_BYTES:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(path)
            size += more
        return out or [_Files([])]

    def _rows(self, store, path: str):
        *_, parent, run, _ = ("", "", *path.split("/"))
        try:
            with store.open_input_stream(path) as stream:
                for data in records(stream, self.verify):
                    for wall, step, tag, value in scalars(data):
                        yield parent, run, round(wall * 1e6), tag, step, value
        except (Damaged, IndexError, struct.error) as fault:
            if self.strict:
                raise Damaged(f"{path}: {fault}") from fault

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        held = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), _ARROW)], schema=_ARROW)

        for path in partition.paths:
            for row in self._rows(store, path):
                held.append(row)
                if len(held) == ROWS:
                    yield batch()
                    held = []
        if held:
            yield batch()


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Files are written under a hidden name and get their own when the job commits, so lost attempts leave no rows."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _opened(self.path)
        at, stream, files = None, None, []
        for batch in batches:
            for parent, run, wall, tag, step, value in zip(*(batch.column(f.name).cast(pa.int64() if f.name == "run_ts" else f.type).to_pylist() for f in _ARROW)):
                if tag is None or step is None or value is None:
                    continue
                wall = (wall or 0) / 1e6
                if (parent, run) != at:
                    if stream:
                        stream.close()
                    folder, name = "/".join(p for p in (root, parent, run) if p), f"{PREFIX}.{int(wall)}.{uuid.uuid4().hex}"
                    store.create_dir(folder)
                    stream, at = store.open_output_stream(f"{folder}/_{name}"), (parent, run)
                    files.append((f"{folder}/_{name}", f"{folder}/{name}"))
                    stream.write(record(event(wall)))
                stream.write(record(event(wall, step=step, tag=tag, value=value)))
        if stream:
            stream.close()
        return _Written(files)

    def commit(self, messages) -> None:
        store, _ = _opened(self.path)
        for done in messages:
            for hidden, named in done.files if done else ():
                store.move(hidden, named)

    def abort(self, messages) -> None:
        store, _ = _opened(self.path)
        for done in messages:
            for hidden, _ in done.files if done else ():
                store.delete_file(hidden)


class EventLogs(DataSource):
    """Options: ``path`` a file or a folder searched to any depth; ``mode`` ``dropTail`` or ``failFast``; ``verify`` checksums."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("event logs are only added to")
        return _Writer(self.options["path"])


def scan_event_logs(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Scalars of all log files under ``path``: ``parent``, ``run_id``, ``run_ts`` (wall time), ``tag``, ``step``, ``value``.

    The run is the folder of a file, the parent the folder around it. Values are as precise as the format,
    32 bits. A file is read up to its first damaged or incomplete record; with ``strict`` such a file raises.
    Files without scalars and folders without files give no rows.
    """
    spark.dataSource.register(EventLogs)
    return spark.read.format("event_log").option("path", path).option("mode", "failFast" if strict else "dropTail").load()


def write_event_logs(log: DataFrame, path: str) -> None:
    """Add the scalars of a metric log, one file per run, in step order. Rows without tag, step or value are left out."""
    spark = log.sparkSession
    spark.dataSource.register(EventLogs)
    parent = F.col("parent") if "parent" in log.columns else F.lit("").alias("parent")
    rows = log.select(parent, F.col("run_id").cast("string"), F.col("run_ts").cast("timestamp"), "tag", F.col("step").cast("long"), F.col("value").cast("double"))
    rows = rows.repartition("parent", "run_id").sortWithinPartitions("parent", "run_id", "step", "tag", "value")
    rows.write.format("event_log").option("path", path).mode("append").save()
