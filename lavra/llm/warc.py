"""WARC archives with a two-level capture index.

Each writing task appends gzip members, one per record, to archives of its own; the table of captures it
returns names only files of the attempt that was committed. Captures are range-sorted by reversed-host
key and cut into compressed blocks; the directory keeps one row per block. Readers binary-search the
directory, read the block's byte range, then the records' byte ranges.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import posixpath
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from lavra.operators.skew import heavy_keys, split_by_filter
from lavra.session import fence, new_scratch, stage

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 3000
SEGMENTS = 4096
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, port, then path and query; no scheme, user or fragment."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#:]*(:\d+)", 1)
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^#]*)", 1)
    rest = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.coalesce(F.concat(reversed_host, port, F.lit(")"), rest), F.lit(""))


def mark_revisits(pages: DataFrame, *, key="page_id", url="url", html="html", least: int = REVISIT_BYTES) -> DataFrame:
    """Rows ready to write: key, url, payload, digest, and for a revisit the key it refers to.

    Of equal payloads of ``least`` bytes or more, the row with the largest key is the response. Rows that
    repeat that key, and rows without key, are responses too. A null payload is empty; revisits carry none.

    Keys and digests are grouped first. A Bloom filter of the repeated digests then lets all other payloads
    pass where they lie; digests on more than a thousandth of the rows, a thousand at most, meet their
    response there as well. Only what is left is shuffled.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    sized = fence(rows, F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    large = stage(sized.where(F.col("size") >= least).select("page_id", "digest"), "digests")
    last = large.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    last = stage(last.where("n > 1").select("digest", "last"), "repeated")
    heavy = F.col("digest").isin(heavy_keys(large, "digest"))
    moved, still = split_by_filter(sized, last.where(~heavy), "digest", last.count())
    joined = still.join(F.broadcast(last.where(heavy)), "digest", "left").unionByName(moved.join(last, "digest", "left"))
    refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
    kept = F.when(refers.isNull(), F.col("payload"))
    return joined.select("page_id", "url", url_key(F.col("url")).alias("url_key"), kept.alias("payload"), "digest", "size", refers.alias("refers_to"))


def _record(row, number: str) -> bytes:
    head = [f"WARC-Type: {'response' if row['refers_to'] is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{number}>"]
    if row["url"]:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', row['url'])}")
    head += [f"WARC-Date: {_DATE}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()]
    head.append(f"X-Payload-Length: {row['size']}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    body = http
    if row["refers_to"] is None:
        body += row["payload"]
    else:
        head += [f"WARC-Refers-To: <urn:page:{row['refers_to']}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class _Files:
    """Files of one folder on any file system pyarrow knows; names are never used twice."""

    def __init__(self, folder: str, suffix: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.suffix, self.stream = suffix, None

    def append(self, data: bytes) -> tuple[str, int]:
        """Name and offset of the written bytes."""
        if self.stream is None or self.at > ARCHIVE_BYTES:
            self.close()
            self.name, self.at = uuid.uuid4().hex + self.suffix, 0
            path = posixpath.join(self.folder, self.name)
            self.stream = self.store.open_output_stream(path, compression=None)
        self.stream.write(data)
        place, self.at = self.at, self.at + len(data)
        return self.name, place

    def close(self):
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class _Ranges:
    """Byte ranges of files in one folder; the last file stays open."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.store.open_input_file(posixpath.join(self.folder, name))
        return self.file.read_at(length, offset)


_CAPTURE = "url_key string, page_id long, file string, offset long, length long"
_CAPTURE_ARROW = pa.schema(
    [("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)


def _writer(folder: str):
    def run(batches):
        files = _Files(folder, ".warc.gz")
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                number = "" if row["page_id"] is None else str(row["page_id"])
                data = _gzip(_record(row, number))
                out.append((row["url_key"], row["page_id"], *files.append(data), len(data)))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CAPTURE_ARROW)], schema=_CAPTURE_ARROW)
        files.close()

    return run


_DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines long"


def _block_writer(folder: str):
    schema = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])

    def run(batches):
        files, held = _Files(folder, ".cdx.gz"), []

        def block(rows):
            lines = ["\t".join([k, "" if p is None else str(p), f, str(o), str(n)]) for k, p, f, o, n in rows]
            data = _gzip("\n".join(lines).encode())
            row = (rows[0][0], rows[-1][0], *files.append(data), len(data), len(rows))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in _CAPTURE_ARROW.names))
            while len(held) >= BLOCK_LINES:
                yield block(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if held:
            yield block(held)
        files.close()

    return run


def write_archives(marked: DataFrame) -> tuple[DataFrame, str]:
    """Write the rows of ``mark_revisits``; the stored block directory and the folder of all files."""
    spark = marked.sparkSession
    folder = new_scratch(spark, "warc")
    captures = stage(marked.mapInArrow(_writer(folder), _CAPTURE), "captures")
    # Tabs and line ends would break the index lines; a URL has none once it is written.
    clean = captures.withColumn("url_key", F.regexp_replace("url_key", r"[\x00-\x20\x7f]", "_"))
    ordered = clean.repartitionByRange("url_key", "page_id", "file", "offset").sortWithinPartitions("url_key", "page_id")
    directory = stage(ordered.mapInArrow(_block_writer(folder), _DIRECTORY), "directory")
    return directory, folder


_BLOCK_LINE = f"{_CAPTURE}, block_file string, block_offset long"


def _block_reader(folder: str):
    schema = _CAPTURE_ARROW.append(pa.field("block_file", pa.string())).append(pa.field("block_offset", pa.int64()))

    def run(batches):
        ranges = _Ranges(folder)
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                lines = zlib.decompress(ranges.read(file, offset, length), 31).decode().split("\n")
                rows = [x.split("\t") for x in lines]
                columns = [[r[0] for r in rows], [int(r[1]) if r[1] else None for r in rows], [r[2] for r in rows]]
                columns += [[int(r[3]) for r in rows], [int(r[4]) for r in rows], [file] * len(rows), [offset] * len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _block_lines(blocks: DataFrame, folder: str) -> DataFrame:
    return blocks.select("file", "offset", "length").mapInArrow(_block_reader(folder), _BLOCK_LINE)


def read_blocks(blocks: DataFrame, folder: str) -> DataFrame:
    """All captures of the blocks of a directory."""
    return _block_lines(blocks, folder).drop("block_file", "block_offset")


_RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(text: str | None):
    found = re.search(r"urn:page:(-?\d+)", text or "")
    return int(found[1]) if found else None


def _parsed(data: bytes):
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = body[: int(fields["Content-Length"])]
    kind = fields["WARC-Type"]
    payload = body.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if kind == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(fields["X-Payload-Length"])
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return _number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload, size, digest, kind, _number(fields.get("WARC-Refers-To"))


def _record_reader(folder: str):
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = pa.schema(list(zip([c.split()[0] for c in _RECORD.split(", ")], kinds)))

    def run(batches):
        ranges = _Ranges(folder)

        def some(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema=schema)

        for batch in batches:
            held, size = [], 0
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                held.append(_parsed(zlib.decompress(ranges.read(file, offset, length), 31)))
                size += held[-1][3]
                if size > 8 << 20:
                    yield some(held)
                    held, size = [], 0
            if held:
                yield some(held)

    return run


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """The records of captures, read in file order. Digests and sizes of responses are those of what was read."""
    ordered = captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(_record_reader(folder), _RECORD)


_FOUND = "k string, file string, offset long, length long"


def _searcher(batches):
    """Of rows sorted by segment, blocks before keys: each key with the block of its segment that may hold it."""
    schema = pa.schema([("k", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    segment, firsts, blocks = None, [], []
    for batch in batches:
        found = []
        for seg, k, last, *block in zip(*(batch.column(c).to_pylist() for c in ("seg", "k", "last_key", "file", "offset", "length"))):
            if seg != segment:
                segment, firsts, blocks = seg, [], []
            if last is not None:
                firsts.append(k)
                blocks.append((last, block))
                continue
            at = bisect.bisect_left(firsts, k) - 1
            if at >= 0 and k <= blocks[at][0]:
                found.append((k, *blocks[at][1]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def _sample(keys: DataFrame, most: int) -> list[str]:
    """About ``most`` of the keys, or all if they are fewer, chosen by hash."""
    step = max(1, -(-keys.count() // most))
    return [r[0] for r in keys.where(F.pmod(F.xxhash64(keys.columns[0], F.lit(step)), F.lit(step)) == 0).toLocalIterator()]


def _places(wanted: DataFrame, directory: DataFrame) -> DataFrame:
    """Each key with each block that may hold it. A key meets a block that begins before it at most once."""
    spans = directory.where("first_key < last_key")
    heads = sorted({*_sample(wanted.select("k"), SEGMENTS), *_sample(spans.select("first_key"), SEGMENTS)})
    shared = wanted.sparkSession.sparkContext.broadcast(heads)

    @F.arrow_udf("int")
    def segment(keys: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_left(shared.value, k) for k in keys.to_pylist()], pa.int32())

    @F.arrow_udf("int")
    def segment_after(keys: pa.Array) -> pa.Array:
        return pa.array([bisect.bisect_right(shared.value, k) for k in keys.to_pylist()], pa.int32())

    # A block stands in each segment that it reaches into.
    reach = F.explode(F.sequence(segment_after("first_key"), segment("last_key"))).alias("seg")
    blocks = spans.select(reach, F.col("first_key").alias("k"), "last_key", "file", "offset", "length")
    asked = wanted.select(segment("k").alias("seg"), "k")
    rows = blocks.unionByName(asked, allowMissingColumns=True)
    ordered = rows.repartition("seg").sortWithinPartitions("seg", F.col("last_key").isNull(), "k")
    inside = ordered.mapInArrow(_searcher, _FOUND)
    equal = directory.join(wanted, F.col("first_key") == F.col("k")).select("k", "file", "offset", "length")
    return inside.unionByName(equal)


def lookup(urls: DataFrame, directory: DataFrame, folder: str, *, url="url") -> DataFrame:
    """Captures of each distinct URL, by binary search; a null URL has the empty key.

    At most about twice ``SEGMENTS`` heads, drawn from the URLs' keys and from the directory, are searched
    for the segment of each key and block. URLs and blocks of a segment meet in one task, which holds the
    segment's blocks once and searches their first keys for each URL. Blocks that begin with the very key
    join by equality. Lines of a block meet the keys sought in it by block and key, so that a key with very
    many captures is spread over its blocks.
    """
    wanted = urls.select(F.regexp_replace(url_key(F.col(url).cast("string")), r"[\x00-\x20\x7f]", "_").alias("k"))
    places = stage(_places(stage(wanted.distinct(), "wanted-keys"), directory), "wanted-blocks")
    lines = _block_lines(places.select("file", "offset", "length").distinct(), folder)
    sought = places.select(F.col("k").alias("url_key"), F.col("file").alias("block_file"), F.col("offset").alias("block_offset"))
    return lines.join(sought, ["url_key", "block_file", "block_offset"], "left_semi").select(*_CAPTURE_ARROW.names)
