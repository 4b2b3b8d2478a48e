"""The streaming jobs over the tables, run until the available data is used up.

A table's file is read as a stream through a pattern, as the file source lists folders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgate.constants import FAST_PATH_STEP, TRANSITIONS
from siftgate.operators.states import latest_checkpoint
from siftgate.plans.scratch import scratch_path
from siftgate.plans.screen import audit_events, screen
from siftgate.queries.base import blocklist, document_items, query, table
from siftgate.queries.events import SQL_ILLEGAL, SQL_LATEST, SQL_PAIRED, TIMEOUT_MS, message_rows, state_rows
from siftgate.queries.runs import PLAIN_SLOTS, SQL_PLAIN_AUDIT, SQL_SCREEN, SQL_SCREEN_TABLE, flat, wordlist_table
from siftgate.sources.audit_log import read_audit
from siftgate.sources.audit_sink import read_committed_audit, stream_append_audit
from siftgate.sources.tables import spread
from siftgate.streaming.jobs import (
    file_stream,
    stream_audit,
    stream_dedup,
    stream_latest_state,
    stream_screen,
)
from siftgate.streaming.keyed import stream_illegal_transitions, stream_request_response


def stream_of(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return file_stream(spark, f"{sf_dir}/{name}.parque[t]", schema)


def document_stream(spark, sf_dir):
    return spread(stream_of(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "documents"))


def run_to_end(start, spark, name):
    """Start a job with a fresh sink and checkpoint, wait for it, return the sink's path."""
    base = scratch_path(spark, name)
    start(f"{base}/sink", f"{base}/checkpoint").awaitTermination()
    return f"{base}/sink"


@query("stream_screen", SQL_SCREEN)
def stream_screen_query(spark, sf_dir):
    docs = document_items(document_stream(spark, sf_dir))
    blocked = blocklist(spark, sf_dir)
    sink = run_to_end(
        lambda out, ck: stream_screen(docs, blocked, out, ck, PLAIN_SLOTS), spark, "stream-screen"
    )
    return flat(spark.read.parquet(sink))


@query("stream_screen_wordlist", SQL_SCREEN_TABLE)
def stream_screen_wordlist_query(spark, sf_dir):
    docs = document_items(document_stream(spark, sf_dir))
    blocked, words = blocklist(spark, sf_dir), wordlist_table(spark, sf_dir)
    sink = run_to_end(lambda out, ck: stream_screen(docs, blocked, out, ck, wordlist=words), spark, "stream-screen")
    return flat(spark.read.parquet(sink))


@query(
    "stream_audit",
    f"WITH {SQL_PLAIN_AUDIT} SELECT item_id, agent, score, reason FROM audit",
)
def stream_audit_query(spark, sf_dir):
    docs = document_items(document_stream(spark, sf_dir))
    blocked = blocklist(spark, sf_dir)
    sink = run_to_end(
        lambda out, ck: stream_audit(docs, blocked, f"{out}/result", f"{out}/audit", ck, PLAIN_SLOTS),
        spark,
        "stream-audit",
    )
    return read_audit(spark, f"{sink}/audit").select("item_id", "agent", "score", "reason")


LATENESS_HOURS = 1


def with_closing_event(events, rows, spark, name, wait_ms):
    """The stream with one more event, later than all others by the lateness and wait_ms: the watermark
    passes all that is open. The event is of the newest row's kind; its id is -1."""
    path = scratch_path(spark, name)
    later = F.expr(f"ts + INTERVAL {wait_ms + LATENESS_HOURS * 3_600_000 + 1000} MILLISECONDS")
    rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(1).withColumns({"ts": later, "event_id": F.lit(-1).cast("bigint")}).write.parquet(path)
    return events.unionByName(file_stream(spark, path, rows.schema))


@query("stream_request_response", SQL_PAIRED)
def stream_request_response_query(spark, sf_dir):
    requests = message_rows(table(spark, sf_dir, "events")).where("type = 'check.request'")
    events = with_closing_event(message_rows(stream_of(spark, sf_dir, "events")), requests, spark, "closing", TIMEOUT_MS)
    sink = run_to_end(
        lambda out, ck: stream_request_response(events, "check", out, ck, TIMEOUT_MS, f"{LATENESS_HOURS} hours"), spark, "stream-pairs"
    )
    return spark.read.parquet(sink).where("event_id >= 0").select("event_id", "correlation_id", "response_id", "status")


@query("stream_illegal_transitions", SQL_ILLEGAL)
def stream_illegal_transitions_query(spark, sf_dir):
    """Alerts on the steps of users, whose events arrive as the file has them."""
    newest = state_rows(table(spark, sf_dir, "events"), F.lit("day"))
    events = with_closing_event(state_rows(stream_of(spark, sf_dir, "events"), F.lit("day")), newest, spark, "closing", 0)
    sink = run_to_end(
        lambda out, ck: stream_illegal_transitions(
            events, [*TRANSITIONS, FAST_PATH_STEP], out, ck, key="user_key", lateness=f"{LATENESS_HOURS} hours"
        ),
        spark,
        "stream-steps",
    )
    return spark.read.parquet(sink).where("event_id >= 0").select("user_key", "event_id", "from_state", "to_state")


@query("stream_latest_state", f"WITH {SQL_LATEST} SELECT item_id, state, event_id FROM latest")
def stream_latest_state_query(spark, sf_dir):
    day = F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
    events = state_rows(stream_of(spark, sf_dir, "events"), day)
    sink = run_to_end(lambda out, ck: stream_latest_state(events, out, ck), spark, "stream-latest")
    return latest_checkpoint(spark.read.parquet(sink)).select("item_id", "state", "event_id")


# 2024-01-01 in milliseconds. Time 0 would not do: it equals the first watermark and is late.
_ARRIVAL_START = 1_704_067_200_000


@query("stream_dedup", "SELECT DISTINCT md5(text) AS md5 FROM documents")
def stream_dedup_query(spark, sf_dir):
    """Documents arrive a millisecond apart from 2024 on, in order of their id."""
    docs = stream_of(spark, sf_dir, "documents").select(
        F.md5("text").alias("md5"), F.timestamp_millis(F.lit(_ARRIVAL_START) + F.col("doc_id")).alias("ts")
    )
    sink = run_to_end(
        lambda out, ck: stream_dedup(docs, out, ck, lateness="365 days"), spark, "stream-dedup"
    )
    return spark.read.parquet(sink).select("md5")


@query("stream_append_audit", f"WITH {SQL_PLAIN_AUDIT} SELECT item_id, agent, score, reason FROM audit")
def stream_append_audit_query(spark, sf_dir):
    """The audit of a screened stream, through the sink with a manifest per batch."""
    audit = audit_events(screen(document_items(document_stream(spark, sf_dir)), blocklist(spark, sf_dir), PLAIN_SLOTS))
    sink = run_to_end(lambda out, ck: stream_append_audit(audit, out, ck), spark, "stream-audit-sink")
    return read_committed_audit(spark, sink).select("item_id", "agent", "score", "reason")
