"""State and message operators, in batch and on streams."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftgate.constants import FAST_PATH_STEP, MAIN_PATH
from siftgate.operators.messages import delivered_counts, request_response, topic_filter
from siftgate.operators.ordering import previous_in_key
from siftgate.operators.states import check_transitions, latest_checkpoint, next_state, resume_plan, terminal_items, transition_table
from siftgate.plans.joins import lookup_join
from siftgate.plans.scratch import scratch_path
from siftgate.streaming.jobs import file_stream, stream_latest_state
from siftgate.streaming.keyed import STATE_STORE, stream_illegal_transitions, stream_request_response

START = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, item_id string, state string, ts timestamp"


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture()
def skewed(spark):
    """A third of all rows under one key, many equal times."""
    rng = random.Random(3)
    rows = [
        (i, "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}", rng.choice(MAIN_PATH), at(rng.randrange(500)))
        for i in range(4000)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_previous_in_key_equals_lag(spark, skewed):
    order = ["ts", "event_id"]
    lag = F.lag("state").over(Window.partitionBy("item_id").orderBy(*order))
    expected = {(r.event_id, r.p) for r in skewed.withColumn("p", lag).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = previous_in_key(skewed, "item_id", order, "state", "p").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.event_id, r.p) for r in got} == expected
    assert len(got) == 4000


def test_check_transitions(spark):
    runs = {
        "good": MAIN_PATH,
        "cancelled": ("init", "preprocess", "cancelled"),
        "fast": ("init", "preprocess", "fusion", "done"),
        "bad": ("init", "done", "init"),
    }
    rows = [(n * 100 + i, k, s, at(i)) for n, (k, states) in enumerate(runs.items()) for i, s in enumerate(states)]
    events = spark.createDataFrame(rows, SCHEMA)
    steps = lambda extra: {(r.item_id, r.from_state, r.to_state) for r in check_transitions(events, transition_table(spark, extra)).collect()}
    wrong = {("bad", "init", "done"), ("bad", "done", "init")}
    assert steps([FAST_PATH_STEP]) == wrong
    assert steps([]) == wrong | {("fast", "preprocess", "fusion")}


def test_next_state(spark):
    df = spark.createDataFrame([(s,) for s in (*MAIN_PATH, "failed")], "s string")
    assert [r[0] for r in df.select(next_state(F.col("s"))).collect()] == [*MAIN_PATH[1:], None, None]


def test_checkpoints_and_resume(spark):
    rows = [(1, "a", "init", at(0)), (2, "a", "preprocess", at(1)), (3, "a", "parallel-fan-out", at(1)),
            (4, "b", "init", at(0)), (5, "c", "fusion", at(0)), (6, "c", "done", at(5))]
    events = spark.createDataFrame(rows, SCHEMA)
    latest = latest_checkpoint(events)
    assert {(r.item_id, r.state) for r in latest.collect()} == {("a", "parallel-fan-out"), ("b", "init"), ("c", "done")}
    assert [r.item_id for r in terminal_items(latest).collect()] == ["c"]
    plan = {(r.item_id, r.restart_at, r.skip_preprocess) for r in resume_plan(events).collect()}
    assert plan == {("a", "parallel-fan-out", True), ("b", "preprocess", False)}


def test_topics_and_deliveries(spark):
    events = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a.x")], "event_id bigint, type string")
    subs = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1)], "topic string, subscriber int")
    assert [r.event_id for r in topic_filter(events, "a").collect()] == [1]
    assert {r.event_id: r.delivered for r in delivered_counts(events, subs).collect()} == {1: 2, 2: 0, 3: 0}


def messages(spark, n=600):
    rng = random.Random(5)
    rows = [
        (i, rng.choice(["t.request", "t.response", "other"]), "hot" if rng.random() < 0.34 else f"c{rng.randrange(20)}", at(rng.randrange(300)))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "event_id bigint, type string, correlation_id string, ts timestamp")


def brute_pairs(rows, timeout):
    out = set()
    for i, kind, corr, ts in rows:
        if kind == "t.request":
            answers = [(t, j) for j, k, c, t in rows if k == "t.response" and c == corr and ts <= t <= ts + timedelta(milliseconds=timeout)]
            out.add((i, min(answers)[1] if answers else None))
    return out


@pytest.mark.parametrize("timeout", [5000, 30000])
def test_request_response(spark, timeout):
    rows, events = messages(spark)
    got = request_response(events, "t", timeout).collect()
    assert {(r.event_id, r.response_id) for r in got} == brute_pairs(rows, timeout)
    assert all((r.status == "answered") == (r.response_id is not None) for r in got)


def in_batches(spark, folder, parts):
    """A stream that takes one part per batch, in this order."""
    os.mkdir(folder / "in")
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(folder / f"part{i}"))
        (file,) = (folder / f"part{i}").glob("*.parquet")
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
        os.rename(file, folder / "in" / f"{i}.parquet")
    return file_stream(spark, str(folder / "in"), parts[0].schema, maxFilesPerTrigger=1)


def shuffled(events, n=6):
    """Parts each of which has events older than those of the part before."""
    return [events.where(F.pmod(F.hash("event_id"), F.lit(n)) == i) for i in range(n)]


def rows_in_state(job):
    return job.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("timeout", [5000, 300])  # with 300 ms an id's requests are in many blocks
def test_stream_pairs_equal_batch_over_shuffled_batches(spark, tmp_path, timeout):
    _, events = messages(spark, 200)
    nobody = spark.createDataFrame([(9000, "t.request", None, at(1)), (9001, "t.response", None, at(1))], events.schema)
    events = events.union(nobody)
    closing = spark.createDataFrame([(-1, "t.request", "end", at(9999))], events.schema)
    stream = in_batches(spark, tmp_path, [*shuffled(events), closing])
    job = stream_request_response(stream, "t", str(tmp_path / "out"), str(tmp_path / "ck"), timeout)
    job.awaitTermination()
    assert sum(p["numInputRows"] > 0 for p in job.recentProgress) >= 7
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = request_response(events, "t", timeout).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert rows_in_state(job) <= 4  # the closing request's state and timer; all else is freed


def test_stream_pairs_drop_late_answers_and_time_out_without_them(spark, tmp_path):
    schema = "event_id bigint, type string, correlation_id string, ts timestamp"
    frame = lambda *rows: spark.createDataFrame(list(rows), schema)
    parts = [
        frame((1, "t.request", "a", at(0)), (2, "t.request", "b", at(0)), (3, "t.response", "b", at(2))),
        frame((4, "t.request", "x", at(1000))),  # the watermark goes to 990
        frame((6, "t.request", "y", at(1001))),
        frame((5, "t.response", "a", at(1))),  # in time by its own time, but late
        frame((7, "t.request", "z", at(2000))),
    ]
    stream = in_batches(spark, tmp_path, parts)
    stream_request_response(stream, "t", str(tmp_path / "out"), str(tmp_path / "ck"), 5000, "10 seconds").awaitTermination()
    got = {r.event_id: (r.response_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (None, "timed-out"), 2: (3, "answered"), 4: (None, "timed-out"), 6: (None, "timed-out")}


def test_stream_pairs_go_on_from_a_checkpoint(spark, tmp_path):
    _, events = messages(spark, 100)
    closing = spark.createDataFrame([(-1, "t.request", "end", at(9999))], events.schema)
    for part in (*shuffled(events, 2), closing):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        stream = file_stream(spark, str(tmp_path / "in"), events.schema)
        stream_request_response(stream, "t", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = request_response(events, "t").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_stream_alerts_equal_check_transitions_over_shuffled_batches(spark, tmp_path, skewed):
    nulls = spark.createDataFrame([(9000, None, "init", at(1)), (9001, None, "done", at(2)), (9002, "k1", None, at(3))], SCHEMA)
    events = skewed.union(nulls)
    closing = spark.createDataFrame([(-1, "end", "init", at(9999))], SCHEMA)
    allowed = transition_table(spark, [FAST_PATH_STEP])
    pairs = [tuple(r) for r in allowed.collect()]
    stream = in_batches(spark, tmp_path, [*shuffled(events, 4), closing])
    stream_illegal_transitions(stream, pairs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    expected = check_transitions(events, allowed).select(*got.columns)
    assert got.count() > 1000 and sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_stream_latest_over_two_runs(spark, tmp_path, skewed):
    """Stop after half of the files, go on from the checkpoint, also with the disk-backed store."""
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        for half in (0, 1):
            skewed.where(F.col("event_id") % 2 == half).write.mode("append").parquet(str(tmp_path / "in"))
            stream = file_stream(spark, str(tmp_path / "in"), skewed.schema)
            stream_latest_state(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    finally:
        for key in STATE_STORE:
            spark.conf.unset(key)
    got = latest_checkpoint(spark.read.parquet(str(tmp_path / "out")))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in latest_checkpoint(skewed).collect()}


@pytest.mark.parametrize("fits", [True, False])
@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_lookup_join_salted_equals_broadcast(spark, skewed, fits, how):
    small = spark.createDataFrame([("hot", 1), ("k3", 2)], "item_id string, v int")
    got = lookup_join(skewed, small, ["item_id"], how, ["event_id"], small_fits=fits)
    assert sorted(map(str, got.collect())) == sorted(map(str, skewed.join(small, "item_id", how).collect()))


def test_scratch_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_path(spark, "x")
    assert path != scratch_path(spark, "x")
    assert base is None or path.startswith(base)
