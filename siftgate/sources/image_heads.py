"""Image facts of files, read from their heads only.

A data source that plans files as partitions, drops files by pushed-down filters on path
and size before any is opened, and reads small byte ranges of a file until its header
is known: a PNG's first bytes, a JPEG's markers from segment to segment without what lies between.
The driver lists folders level by level until it has plannedFiles files; folders it has not
listed by then are listed by tasks, so its work and memory have a bound if no folder is large.
Files are reached through Arrow's file systems (local folders and mounts, hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import uuid
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

COLUMNS = "path string, size long, format string, width long, height long, bytes_read long"
NAME = "image_heads"
PARTITION_FILES = 1_000
PLANNED_FILES = 50_000
FOLDER_PARTITIONS = 10_000
RANGE = 4_096
_PNG, _JPEG = b"\x89PNG", b"\xff\xd8"


class Head:
    """A file of which ranges are read as they are asked for; counts the bytes that were."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.read = file, size, 0
        self.start, self.held = 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.held):
            self.file.seek(at)
            self.start, self.held = at, self.file.read(max(n, min(RANGE, self.size - at)))
            self.read += len(self.held)
        return self.held[at - self.start : at - self.start + n]

    def find(self, byte: bytes, at: int, end: int) -> int:
        while at < end:
            self.bytes(at, 1)
            place = self.held.find(byte, at - self.start, end - self.start)
            if place >= 0:
                return self.start + place
            at = self.start + len(self.held)
        return -1


def head_facts(head: Head) -> tuple[str, int, int]:
    """(format, width, height); unknown, 0, 0 for other files and those whose frame is never found."""
    first = head.bytes(0, min(24, head.size))
    if len(first) == 24 and first[:4] == _PNG:
        return "png", int.from_bytes(first[16:20], "big"), int.from_bytes(first[20:24], "big")
    if len(first) >= 4 and first[:2] == _JPEG:
        at, last = 2, head.size - 8
        while at < last:
            at = head.find(b"\xff", at, last)
            if at < 0:
                break
            segment = head.bytes(at, min(9, head.size - at))
            kind = segment[1]
            if 0xD0 <= kind <= 0xD9:
                at += 2
            elif kind in (0xC0, 0xC2):
                return "jpeg", int.from_bytes(segment[7:9], "big"), int.from_bytes(segment[5:7], "big")
            else:
                at += 2 + int.from_bytes(segment[2:4], "big")
    return "unknown", 0, 0


@dataclass
class Files(InputPartition):
    """Files listed by the driver, or folders that a task lists to their leaves."""

    files: list[tuple[str, int]]
    folders: list[str]


_TESTS = {
    IsNotNull: lambda a, b: True,
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    StringStartsWith: lambda a, b: a.startswith(b),
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class FileWriter(DataSourceArrowWriter):
    """Each row (name, content) becomes a file. A file is moved to its name when it is whole, so
    a repeated task puts the same file there again."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = opened(self.folder)
        fs.create_dir(base, recursive=True)
        made = {base}
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                parent = f"{base}/{name}".rpartition("/")[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                draft = f"{parent}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(draft, compression=None) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                fs.move(draft, f"{base}/{name}")
        return WriterCommitMessage()


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.names = {k.lower(): v for k, v in options.items()}, schema.names
        self.filters: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute in (("path",), ("size",)):
                self.filters.append((type(f), f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def listed(self, fs: pafs.FileSystem, pending: deque[str]) -> Iterator[list[tuple[str, int]]]:
        """The wanted files (path, size) of each pending folder; a folder's folders become pending when it is taken."""
        glob = self.options.get("pathglobfilter", "*")
        while pending:
            found = []
            for info in fs.get_file_info(pafs.FileSelector(pending.popleft())):
                if info.type == pafs.FileType.Directory:
                    pending.append(info.path)
                hidden = info.base_name.startswith(("_", "."))
                if info.is_file and not hidden and fnmatch.fnmatch(info.base_name, glob):
                    values = {"path": info.path, "size": info.size}
                    if all(_TESTS[kind](values[name], value) for kind, name, value in self.filters):
                        found.append((info.path, info.size))
            yield sorted(found)

    def partitions(self) -> Sequence[Files]:
        fs, base = opened(self.options["path"])
        limit, found, pending = int(self.options.get("plannedfiles", PLANNED_FILES)), [], deque([base])
        for files in self.listed(fs, pending):
            found += files
            if len(found) >= limit:
                break
        found.sort()
        n, m = int(self.options.get("partitionfiles", PARTITION_FILES)), -(-len(pending) // FOLDER_PARTITIONS) or 1
        parts = [Files(list(part), []) for part in batched(found, n)]
        parts += [Files([], list(part)) for part in batched(pending, m)]
        return parts or [Files([], [])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.options["path"])
        n = int(self.options.get("partitionfiles", PARTITION_FILES))
        yield self.facts(fs, partition.files)
        for files in self.listed(fs, deque(partition.folders)):
            for part in batched(files, n):
                yield self.facts(fs, part)

    def facts(self, fs: pafs.FileSystem, files: Sequence[tuple[str, int]]) -> pa.RecordBatch:
        rows: dict[str, list] = {name: [] for name in ("path", "size", "format", "width", "height", "bytes_read")}
        opens = not {"format", "width", "height", "bytes_read"}.isdisjoint(self.names)
        for path, size in files:
            facts, read = ("unknown", 0, 0), 0
            if opens:
                with fs.open_input_file(path) as file:
                    head = Head(file, size)
                    facts, read = head_facts(head), head.read
            for name, value in zip(rows, (path, size, *facts, read)):
                rows[name].append(value)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = {name: pa.array(values, kind) for (name, values), kind in zip(rows.items(), kinds)}
        return pa.RecordBatch.from_arrays([columns[name] for name in self.names], self.names)


class ImageHeads(DataSource):
    """Options: path (a folder, searched to its leaves), pathGlobFilter, partitionFiles (files per task of those
    that the driver lists), plannedFiles (after so many the driver leaves further folders to tasks)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """Write rows (name, content) as files of a folder; names are plain or have folders before them, and distinct.

    One task writes one partition's files, and a flat folder of millions is listed by one reader: deal
    small rows to partitions before they get their bytes, and put some thousand files in a folder each."""
    files.sparkSession.dataSource.register(ImageHeads)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format(NAME).mode("append").option("path", folder).save()


def read_image_heads(spark: SparkSession, path: str, columns: Sequence[str] = (), **options: str) -> DataFrame:
    """COLUMNS, or those named, of all files below a folder; without image columns no file is opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageHeads)
    schema = ", ".join(c.strip() for c in COLUMNS.split(",") if not columns or c.split()[0] in columns)
    return spark.read.format(NAME).schema(schema).options(**options).option("path", path).load()


def file_inventory(heads: DataFrame) -> DataFrame:
    """Files per format and size, as `image_inventory` counts items."""
    return heads.groupBy("format", "width", "height").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
