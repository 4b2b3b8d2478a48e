"""Files of pictures and audit lines: heads only, commits only."""

import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgate.operators.images import image_inventory
from siftgate.queries import QUERIES, bytes_, tables
from siftgate.sources import audit_sink
from siftgate.sources.audit_sink import append_audit, read_committed_audit, stream_append_audit
from siftgate.sources.image_heads import Reader, file_inventory, read_image_heads, write_files
from siftgate.sources.items import read_items
from siftgate.streaming.jobs import file_stream


def jpeg(width, height, before=3, junk=50_000):
    """A JPEG whose frame comes after segments of some 50 KB each."""
    segments = b"".join(b"\xff\xe1" + struct.pack(">H", junk) + b"\0" * (junk - 2) for _ in range(before))
    frame = b"\xff\xc0" + struct.pack(">HBHH", 17, 8, height, width) + b"\0" * 12
    return b"\xff\xd8" + segments + frame + b"\0" * 100_000 + b"\xff\xd9"


def png(width, height, n=100_000):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + b"\x08\x06\0\0\0" + b"\0" * n


FILES = {
    "a.png": png(640, 480),
    "b.jpg": jpeg(320, 200),
    "c.jpg": jpeg(16, 9, before=0),
    "d.txt": b"this is not an image at all",
    "e.bin": b"",
    "f.jpg": b"\xff\xd8" + b"\0" * 30_000,  # no frame
    "g.jpg": b"\xff\xd8\xff\xc0",
    "h.png": png(1, 1)[:20],
}


@pytest.fixture()
def folder(spark, tmp_path):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "name string, content binary")
    write_files(files.repartition(3), str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_heads_equal_the_inventory_of_whole_files(spark, folder):
    heads = read_image_heads(spark, folder, partitionFiles="3")
    rows = {r.path.rsplit("/", 1)[1]: r for r in heads.collect()}
    assert {k: r.size for k, r in rows.items()} == {k: len(v) for k, v in FILES.items()}
    assert (rows["b.jpg"].format, rows["b.jpg"].width, rows["b.jpg"].height) == ("jpeg", 320, 200)
    assert rows["a.png"].bytes_read <= 4096 and rows["b.jpg"].bytes_read <= 6 * 4096  # of 250 KB
    expected = image_inventory(read_items(spark, folder))  # which passes empty files over
    assert sorted(map(tuple, file_inventory(heads.where("size > 0")).collect())) == sorted(map(tuple, expected.collect()))


def test_filters_drop_files_before_they_are_opened(spark, folder):
    some = read_image_heads(spark, folder, ("path", "size", "format")).where("size > 50000 AND size < 200000")
    assert sorted(r.path.rsplit("/", 1)[1] for r in some.collect()) == ["a.png", "c.jpg"]
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert read_image_heads(spark, folder, pathGlobFilter="*.jpg").count() == 4
    one = read_image_heads(spark, folder, ("path",)).where(F.col("path") == f"{folder}/e.bin")
    assert one.count() == 1


def test_folders_beyond_the_planned_files_are_listed_by_tasks(spark, tmp_path):
    names = [f"{i % 7}/{i % 2}/{i}.png" for i in range(40)] + ["top.png"]
    files = spark.createDataFrame([(n, bytearray(png(i + 1, 5, i))) for i, n in enumerate(names)], "name string, content binary")
    path = str(tmp_path / "in")
    write_files(files.repartition(4), path)
    found = sorted(map(tuple, read_image_heads(spark, path).collect()))
    assert [r[0] for r in found] == sorted(f"{path}/{n}" for n in names) and {r[3] for r in found} == set(range(1, 42))
    for limit in ("0", "1", "2", "9"):
        few = read_image_heads(spark, path, plannedFiles=limit, partitionFiles="2")
        assert sorted(map(tuple, few.collect())) == found
        large = read_image_heads(spark, path, ("path", "size"), plannedFiles=limit).where("size > 60")
        assert sorted(map(tuple, large.collect())) == [r[:2] for r in found if r[1] > 60]
        assert read_image_heads(spark, path, plannedFiles=limit, pathGlobFilter="*1.png").count() == 4
    reader = Reader({"path": path, "plannedFiles": "1"}, few.schema)
    parts = reader.partitions()
    assert sum(len(p.files) for p in parts) == 1 and sorted(f for p in parts for f in p.folders) == [f"{path}/{i}" for i in range(7)]


@pytest.mark.parametrize(("module", "name"), [(bytes_, "image_heads"), (tables, "read_items")])
def test_queries_write_files_in_as_many_tasks_as_cores(spark, monkeypatch, module, name):
    written = []
    monkeypatch.setattr(module, "write_files", lambda files, folder: (written.append(files), write_files(files, folder)))
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert written[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


AUDIT = "item_id string, agent string, score double, reason string"


def test_appended_audit_reads_back(spark, tmp_path):
    path = str(tmp_path / "audit")
    for part in ([("1", "a", 0.5, "x"), ("2", None, None, "é\n\"")], [], [("1", "a", 0.5, "x")]):
        append_audit(spark.createDataFrame(part, AUDIT), path)
    got = read_committed_audit(spark, path)
    assert sorted(map(str, got.select("item_id", "agent", "score", "reason").collect())) == sorted(
        map(str, spark.createDataFrame([("1", "a", 0.5, "x"), ("2", None, None, "é\n\""), ("1", "a", 0.5, "x")], AUDIT).collect())
    )
    assert got.where("_corrupt_record IS NOT NULL").count() == 0
    assert read_committed_audit(spark, str(tmp_path / "none")).count() == 0


def test_lost_and_repeated_attempts_neither_lose_nor_double_lines(spark, tmp_path):
    path = str(tmp_path / "audit")
    lines = lambda *ids: iter([pa.RecordBatch.from_arrays([pa.array([f'{{"message":"m","context":{{"image_id":"{i}"}}}}' for i in ids])], ["line"])])
    ids = lambda: sorted(r.item_id for r in read_committed_audit(spark, path).collect())
    writer = audit_sink.StreamWriter(path, "s")
    first, lost = writer.write(lines(1, 2)), writer.write(lines(1, 2))  # the second attempt of a task is not counted
    assert ids() == []
    writer.commit([first, writer.write(lines(3)), None], 0)
    assert lost.lines == 2 and ids() == ["1", "2", "3"]
    again = audit_sink.StreamWriter(path, "s")  # batch 0 once more, after a restart that did not know of its commit
    again.commit([again.write(lines(1, 2)), again.write(lines(3))], 0)
    assert ids() == ["1", "2", "3"]
    dropped = again.write(lines(9))
    again.abort([dropped, None], 1)
    again.commit([again.write(lines(4))], 1)
    assert ids() == ["1", "2", "3", "4"]
    other = audit_sink.StreamWriter(path, "another")
    other.commit([other.write(lines(5))], 0)
    assert ids() == ["1", "2", "3", "4", "5"]


def test_a_stream_appends_each_batch_once(spark, tmp_path):
    rows = [(str(i), "a", 0.1, "r") for i in range(40)]
    for half in (0, 1):
        spark.createDataFrame(rows[20 * half : 20 * half + 20], AUDIT).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = file_stream(spark, str(tmp_path / "in"), AUDIT, maxFilesPerTrigger=1)
        stream_append_audit(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    # The last batch is run again: its offsets are there, its commit is not.
    commits = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        f.unlink(missing_ok=True)
    stream = file_stream(spark, str(tmp_path / "in"), AUDIT, maxFilesPerTrigger=1)
    stream_append_audit(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = read_committed_audit(spark, str(tmp_path / "out"))
    assert sorted(r.item_id for r in got.collect()) == sorted(r[0] for r in rows)
