"""WARC files as a Python data source, written and read by Spark tasks.

Writing: each task writes files of gzip members, one per record, and the driver's commit lists
the files of the tasks that succeeded in `_files`, so what a lost or repeated task left is never read. The gzip
header of a member carries its length, which other readers ignore.

Reading: a partition is one file. A record's headers are inflated and parsed first; the tests on the record
type and on the other header columns that Spark pushes down are made on them, and the payload of a
record that fails, or any payload with option `payload=skip`, is neither inflated nor decoded: the reader goes on
at the next member. Files of other writers, of members without a length or of plain records, are read
too.

Columns: record_id, record_type, target_uri, date, payload_digest, refers_to, payload_length (of the whole payload,
also for a revisit, whose record has none), payload (null if skipped).

`archived` turns a table of pages into records: a null payload is an empty one, a null address leaves out the
header, control characters in headers are percent-encoded. Of pages with equal payloads the one with the smallest
id is the response, the others revisit it; repeated rows with that smallest id are all responses. A null
id sorts after all others. An empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .textbytes import q

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, payload binary"
FILE_BYTES = 256 << 20
#: The names of the headers and the profile of revisits in the format.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH = "X-Payload-Length"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark would find it on: without one, a worker would take it
    for a path on its own disk."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(name).toString()


def opened(path: str):
    """(file system, path in it) for a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(record: bytes) -> bytes:
    """The record as a gzip member whose header says how long the member is."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"".join([b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", struct.pack("<H2sHII", 12, b"sl", 8, size, len(record) & 0xFFFFFFFF), body, struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)])


def header(value: str) -> str:
    return "".join(c if " " <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(row) -> bytes:
    payload = b"" if row["record_type"] == "revisit" or row["payload"] is None else bytes(row["payload"])
    lines = ["WARC/1.1", *(f"{h}: {header(row[c])}" for c, h in HEADERS.items() if row[c] is not None)]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    if row["payload_length"] is not None:
        lines.append(f"{LENGTH}: {row['payload_length']}")
    lines += [f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite

    def write(self, rows: Iterator) -> Written:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        try:
            for row in rows:
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{path}/{files[-1]}", compression=None), 0
                out.write(data := member(record(row)))
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, path = opened(self.path)
        fs.create_dir(path, recursive=True)
        before = [] if self.overwrite else listed(self.path)
        with fs.open_output_stream(f"{path}/_files") as f:
            f.write("\n".join([*before, *(name for m in messages if m for name in m.files)]).encode())

    def abort(self, messages: list) -> None:
        fs, path = opened(self.path)
        for m in messages:
            for name in m.files if m else []:
                fs.delete_file(f"{path}/{name}")


def listed(folder: str) -> list[str]:
    """The files of an archive: those its writer committed, or else all that are named like one."""
    from pyarrow import fs as pafs

    fs, path = opened(folder.rstrip("/"))
    if fs.get_file_info(f"{path}/_files").type == pafs.FileType.File:
        with fs.open_input_stream(f"{path}/_files") as f:
            return [x for x in f.read().decode().split("\n") if x]
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(x.base_name for x in found if x.base_name.endswith((".warc", ".warc.gz")))


@dataclass
class File(InputPartition):
    path: str


def parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class Head:
    """Headers of one record, and how to get at its payload."""

    def __init__(self, headers: dict[str, str], payload):
        self.headers, self.payload = headers, payload


def members(f, size: int) -> Iterator[Head]:
    """Records of a file of gzip members. f: a seekable file."""
    at = 0
    while at < size:
        f.seek(at)
        chunk = f.read(2048)
        if chunk[:2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at {at}")
        length = struct.unpack_from("<I", chunk, 16)[0] if chunk[3] & 4 and chunk[12:14] == b"sl" else 0
        z, text = zlib.decompressobj(31), b""
        while True:
            text += z.decompress(chunk)
            if (end := text.find(b"\r\n\r\n")) >= 0 or z.eof:
                break
            chunk = f.read(4096)
            if not chunk:
                raise ValueError(f"the member at {at} has no end")
        headers = parse(text[:end])

        def payload(z=z, text=text, end=end, n=int(headers.get("content-length", 0))) -> bytes:
            parts, have = [text[end + 4 :]], len(text) - end - 4
            while have < n and not z.eof:
                parts.append(z.decompress(f.read(1 << 16)))
                have += len(parts[-1])
            return b"".join(parts)[:n]

        yield Head(headers, payload)
        if length:
            at += length
        else:  # only inflating finds the end
            f.seek(at)
            z = zlib.decompressobj(31)
            while not z.eof:
                chunk = f.read(1 << 16)
                if not chunk:
                    return
                at += len(chunk)
                z.decompress(chunk)
            at -= len(z.unused_data)


def plain(f, size: int) -> Iterator[Head]:
    """Records of a file that isn't compressed."""
    at = 0
    while at < size:
        f.seek(at)
        text = b""
        while (end := text.find(b"\r\n\r\n")) < 0:
            chunk = f.read(4096)
            if not chunk:
                if text.strip():
                    raise ValueError(f"the record at {at} has no end")
                return
            text += chunk
        headers = parse(text[:end])
        start, n = at + end + 4, int(headers.get("content-length", 0))

        def payload(start=start, n=n) -> bytes:
            f.seek(start)
            return f.read(n)

        yield Head(headers, payload)
        at = start + n + 4


class Reader(DataSourceReader):
    def __init__(self, folder: str, skip: bool):
        self.folder, self.skip, self.tests = folder.rstrip("/"), skip, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def partitions(self) -> list[File]:
        return [File(f"{self.folder}/{name}") for name in listed(self.folder)] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = opened(partition.path)
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_length", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        with fs.open_input_file(path) as f:
            records = members if f.read(2) == b"\x1f\x8b" else plain
            for r in records(f, f.size()):
                row = {c: r.headers.get(h.lower()) for c, h in HEADERS.items()}
                if any(row[c] is None or (values is not None and row[c] not in values) for c, values in self.tests):
                    continue
                length = r.headers.get(LENGTH.lower(), r.headers.get("content-length"))
                rows.append(row | {"payload_length": int(length) if length else None, "payload": None if self.skip else r.payload()})
                size += 500 + len(rows[-1]["payload"] or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("payload") == "skip")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", "read" if payload else "skip").load(qualified(spark, folder))


def base32(digest: pd.Series) -> pd.Series:
    """Hexadecimal digests in base32, as the format writes them."""
    return digest.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The records of a table of pages, for `write`. Payloads of fewer than `least` bytes are all
    responses."""
    rows = pages.select(F.col(q(id_col)).alias("id"), F.col(q(url_col)).cast("string").alias("target_uri"), F.coalesce(F.col(q(payload_col)).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    first = rows.groupBy("sha1").agg(F.min("id").alias("first")).withColumn("base32", F.pandas_udf(base32, "string")("sha1"))
    rows = rows.join(first, "sha1")
    revisit = (F.col("payload_length") >= least) & ~F.col("first").eqNullSafe(F.col("id"))
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return rows.select(
        name("id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "base32").alias("payload_digest"), F.when(revisit, name("first")).alias("refers_to"), "payload_length", F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, folder: str, mode: str = "overwrite") -> None:
    register(records.sparkSession)
    records.write.format("warc").mode(mode).save(qualified(records.sparkSession, folder))


def page_id(column: str) -> Column:
    """The id in a record's name; null if it was null."""
    return F.nullif(F.regexp_extract(column, "^<urn:x-page:(.*)>$", 1), F.lit(""))
