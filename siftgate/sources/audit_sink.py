"""Audit lines written with commits, by batch jobs and by streams.

Every task attempt writes a file of its own; a commit names the files of the attempts that
count in a manifest. Readers read what manifests name. So a task that is lost or runs
twice leaves a file that nobody reads, and neither loses nor doubles a line. A stream's manifest
has the batch's number in its name: a batch that is repeated after a restart finds its number
taken and commits nothing, so its lines are there once. Each batch job's commit has a name of its own.

The folder is reached through Arrow's file systems and must be shared by driver and executors.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftgate.sources.audit_log import audit_lines, lines_to_audit

NAME = "audit_lines"
MANIFESTS = "_commits"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    lines: int


class _Files:
    """What batch and stream writers share."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = opened(self.folder)
        fs.create_dir(base, recursive=True)
        name, lines, out = f"lines-{uuid.uuid4().hex}.json", 0, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(("\n".join(batch.column(0).to_pylist()) + "\n").encode())
                lines += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written([name] if lines else [], lines)

    def _commit(self, name: str, messages: list[Written | None]) -> None:
        fs, base = opened(self.folder)
        fs.create_dir(f"{base}/{MANIFESTS}", recursive=True)
        target = f"{base}/{MANIFESTS}/{name}.json"
        if fs.get_file_info(target).is_file:
            return self._drop(messages)
        done = [m for m in messages if m is not None]
        content = json.dumps({"files": sorted(n for m in done for n in m.names), "lines": sum(m.lines for m in done)})
        draft = f"{base}/{MANIFESTS}/.{name}-{uuid.uuid4().hex}"
        with fs.open_output_stream(draft, compression=None) as out:
            out.write(content.encode())
        fs.move(draft, target)  # a manifest is there whole or not at all

    def _drop(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.folder)
        for m in messages:
            for name in m.names if m is not None else ():
                fs.delete_file(f"{base}/{name}")


class BatchWriter(_Files, DataSourceArrowWriter):
    def __init__(self, folder: str):
        super().__init__(folder)
        self.name = f"job-{uuid.uuid4().hex}"

    def commit(self, messages: list[Written | None]) -> None:
        self._commit(self.name, messages)

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(messages)


class StreamWriter(_Files, DataSourceStreamArrowWriter):
    def __init__(self, folder: str, stream: str):
        super().__init__(folder)
        self.stream = stream

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(f"{self.stream}-{batchId:012}", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._drop(messages)


class AuditLines(DataSource):
    """Options: path; stream, a name for the batches of one stream (its checkpoint's life long)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> BatchWriter:
        return BatchWriter(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"], self.options.get("stream", "stream"))


def _lines(audit: DataFrame) -> DataFrame:
    return audit_lines(audit).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def append_audit(audit: DataFrame, path: str) -> None:
    """Append one line per audit row (item_id, agent, score, reason)."""
    audit.sparkSession.dataSource.register(AuditLines)
    _lines(audit).write.format(NAME).mode("append").option("path", path).save()


def stream_append_audit(audit: DataFrame, path: str, checkpoint: str, stream: str = "stream", trigger={"availableNow": True}) -> StreamingQuery:
    """Append the lines of a stream, each batch once whatever is repeated."""
    audit.sparkSession.dataSource.register(AuditLines)
    writer = _lines(audit).writeStream.format(NAME).option("path", path).option("stream", stream)
    return writer.option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def committed_files(path: str) -> list[str]:
    """The files that commits name. One name per task, listed on the driver."""
    fs, base = opened(path)
    names = []
    for info in fs.get_file_info(pafs.FileSelector(f"{base}/{MANIFESTS}", allow_not_found=True)):
        if info.is_file and not info.base_name.startswith("."):
            with fs.open_input_stream(info.path) as f:
                names += json.loads(f.read())["files"]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names)]


def read_committed_audit(spark: SparkSession, path: str, keep_corrupt: bool = True) -> DataFrame:
    """As `read_audit`, of the committed lines only."""
    files = committed_files(path)
    lines = spark.read.text(files) if files else spark.createDataFrame([], "value string")
    return lines_to_audit(lines, keep_corrupt)
