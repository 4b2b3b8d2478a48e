"""WARC archives as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Writing. Each task writes files of up to FILE_BYTES under names of its own attempt; the
driver's commit lists the files of the attempts that count in a manifest, so what a lost or repeated
task leaves behind is never read. Of equal payloads only one record holds the payload, the others
are revisit records that keep its HTTP headers, and with them its length, and its digest.

Reading. The files of a folder are planned as partitions. Equality filters on record_type, page_id,
target_uri, payload_digest and refers_to, and null tests on the last, are pushed down and tested on
the record's headers, which are parsed first. Each record is a gzip member that tells its length, so
the rest of a record that fails is never inflated but sought past, and so are all payloads
when the read's schema has no `payload`.

Files are opened through pyarrow's file systems by the path's scheme, so folders may be in any
store that all executors reach. Null payloads count as empty. A null id is written as an
empty one and read back as null; of equal payloads, rows with the largest id (nulls
smallest) are responses, more than one where the id repeats. Empty tables give no files.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from siftgate.plans.joins import lookup_join
from siftgate.plans.scratch import written

# Names and marks of the archive format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
WRITTEN = "page_id long, target_uri string, payload binary, record_type string, refers_to long"
READ = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
# Each commit adds a manifest of its own; the archive is what all of them name.
MANIFEST = "_manifest"
DATE = "2000-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
PUSHED = {"record_type", "page_id", "target_uri", "payload_digest", "refers_to"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    digits = (urn or "")[len("<urn:page:") : -1]
    return int(digits) if digits else None


def _clean(value: str | None) -> str:
    return (value or "").replace("\r", " ").replace("\n", " ")


def record(row) -> bytes:
    """One archive record of a row of WRITTEN. A revisit has its HTTP headers, but not the payload."""
    payload = bytes(row.payload or b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if row.record_type == "response" else http
    headers = [
        ("WARC-Type", row.record_type),
        ("WARC-Record-ID", _urn(row.page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if row.target_uri is not None:
        headers.append(("WARC-Target-URI", _clean(row.target_uri)))
    if row.record_type == "revisit":
        headers += [("WARC-Refers-To", _urn(row.refers_to)), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    return member(VERSION + b"\r\n" + lines + b"\r\n" + block + END)


@dataclass
class Files(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Written:
        fs, base = opened(self.folder)
        fs.create_dir(base, recursive=True)
        names: list[str] = []
        out, size = None, 0
        try:
            for row in rows:
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                data = record(row)
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.folder)
        fs.create_dir(base, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.names)
        with fs.open_output_stream(f"{base}/{MANIFEST}-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.folder)
        for m in messages:
            for name in m.names if m is not None else ():
                fs.delete_file(f"{base}/{name}")


def member(data: bytes) -> bytes:
    """A gzip member that tells its own length in the extra field, so that readers can skip it."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = GZIP + struct.pack("<H2sHQQ", 20, b"SL", 16, len(body), len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Member:
    """A record whose bytes are inflated as far as they are asked for."""

    def __init__(self, stream, left: int):
        self.stream, self.left = stream, left
        self.inflate = zlib.decompressobj(-15)
        self.text = b""

    def more(self, size: int) -> bool:
        got = self.stream.read(min(size, self.left))
        self.left -= len(got)
        self.text += self.inflate.decompress(got)
        return bool(got)

    def block(self) -> dict[str, str]:
        """The lines up to the next empty one as names and values; a first line without a name is passed over."""
        while END not in self.text and self.more(1024):
            pass
        lines, _, self.text = self.text.partition(END)
        pairs = [line.partition(":") for line in lines.decode().split("\r\n")[1:]]
        return {name.strip().lower(): value.strip() for name, _, value in pairs}

    def payload(self, size: int) -> bytes:
        while len(self.text) < size and self.more(1 << 20):
            pass
        return self.text[:size]


def _fields(headers: dict[str, str]) -> dict:
    return {
        "page_id": _page(headers.get("warc-record-id")),
        "target_uri": headers.get("warc-target-uri"),
        "record_type": headers.get("warc-type"),
        "refers_to": _page(headers.get("warc-refers-to")),
        "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:"),
    }


def _holds(fields: dict, f: Filter) -> bool:
    value = fields[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, IsNotNull):
        return value is not None
    if isinstance(f, In):
        return value in f.value
    return value == f.value


class Reader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names, self.filters = folder, schema.names, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in PUSHED:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[Files]:
        fs, base = opened(self.folder)
        names = []
        for info in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda f: f.path):
            if info.base_name.startswith(MANIFEST):
                with fs.open_input_stream(info.path) as f:
                    names += json.loads(f.read())
        return [Files(f"{base}/{n}") for n in names] or [Files("")]

    def read(self, partition: Files) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = opened(self.folder)
        with fs.open_input_file(partition.path) as raw, io.BufferedReader(raw, 1 << 16) as stream:
            while head := stream.read(len(GZIP) + 22):
                if head[: len(GZIP)] != GZIP:
                    raise ValueError(f"no record at a record's place in {partition.path}")
                size = struct.unpack_from("<Q", head, len(GZIP) + 6)[0]
                end = stream.tell() + size + 8
                record = Member(stream, size)
                fields = _fields(record.block())
                if all(_holds(fields, f) for f in self.filters):
                    if "payload_bytes" in self.names or "payload" in self.names:
                        fields["payload_bytes"] = int(record.block()["content-length"])
                    if "payload" in self.names:
                        whole = fields["record_type"] == "response"
                        fields["payload"] = record.payload(fields["payload_bytes"]) if whole else None
                    yield tuple(fields[n] for n in self.names)
                stream.seek(end)


class WarcSource(DataSource):
    """Options: path. A read's schema may name any of the columns of READ."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Rows of WRITTEN. Payloads shorter than min_revisit_bytes are all responses.

    Equal payloads meet by digest and length; the largest id per digest is found with
    partial maxima, so a payload shared by very many pages is no hot group there. Only
    payloads that occur more than once are looked up: by a broadcast of their digests while
    those are few, so payloads do not move, else by a join salted per digest.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    keyed = rows.withColumns({"key": F.sha1("payload"), "size": F.octet_length("payload")})
    best = keyed.where(F.col("size") >= min_revisit_bytes).groupBy("key", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    joined = lookup_join(keyed, written(best.where("n > 1").drop("n"), "kept"), ["key", "size"], "left", salt_by=["page_id", "target_uri"])
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select(
        "page_id",
        "target_uri",
        "payload",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("kept")).alias("refers_to"),
    )


def write_archive(pages: DataFrame, folder: str, **options) -> None:
    register(pages.sparkSession)
    rows = archive_rows(pages, **options)
    rows.write.format("warc").mode("append").option("path", folder).save()


def read_archive(spark: SparkSession, folder: str, columns: Sequence[str] = ()) -> DataFrame:
    """All columns of READ, or those named; without `payload` no payload is decoded."""
    register(spark)
    schema = ", ".join(c.strip() for c in READ.split(",") if not columns or c.split()[0] in columns)
    return spark.read.format("warc").schema(schema).option("path", folder).load()
