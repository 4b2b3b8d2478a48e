"""State and message operators over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgate.constants import FAST_PATH_STEP, MAIN_PATH, TERMINAL_STATES, TRANSITIONS
from siftgate.operators.messages import delivered_counts, request_response, topic_filter
from siftgate.operators.states import (
    check_transitions,
    latest_checkpoint,
    next_state,
    resume_plan,
    terminal_items,
    transition_table,
)
from siftgate.queries.base import query, table

# Event types stand for states, users (or users on one day) for items.
_STATE = """CASE event_type WHEN 'signup' THEN 'init' WHEN 'view' THEN 'preprocess'
  WHEN 'click' THEN 'parallel-fan-out' WHEN 'purchase' THEN 'done' ELSE 'failed' END"""
SQL_STATES = f"""states AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS user_key,
         CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS item_id, {_STATE} AS state FROM events)"""


def states(spark, sf_dir):
    day = F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
    return state_rows(table(spark, sf_dir, "events"), day)


def state_rows(events, key):
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("user_key"),
        key.alias("item_id"),
        F.expr(_STATE).alias("state"),
    )


_STEPS = ", ".join(f"('{a}', '{b}')" for a, b in (*TRANSITIONS, FAST_PATH_STEP))


SQL_ILLEGAL = f"""WITH {SQL_STATES}, allowed(from_state, to_state) AS (VALUES {_STEPS}),
steps AS (SELECT user_key, event_id, lag(state) OVER (PARTITION BY user_key ORDER BY ts, event_id) AS from_state, state AS to_state FROM states)
SELECT user_key, event_id, from_state, to_state FROM steps ANTI JOIN allowed USING (from_state, to_state)
WHERE from_state IS NOT NULL"""


@query("check_transitions", SQL_ILLEGAL)
def check_transitions_query(spark, sf_dir):
    allowed = transition_table(spark, [FAST_PATH_STEP])
    return check_transitions(states(spark, sf_dir), allowed, key="user_key").drop("ts")


_NEXT = ", ".join(f"('{a}', '{b}')" for a, b in zip(MAIN_PATH, MAIN_PATH[1:]))


@query(
    "next_state",
    f"""WITH {SQL_STATES}, path(state, next_state) AS (VALUES {_NEXT})
SELECT event_id, state, next_state FROM states LEFT JOIN path USING (state)""",
)
def next_state_query(spark, sf_dir):
    return states(spark, sf_dir).select("event_id", "state", next_state(F.col("state")).alias("next_state"))


SQL_LATEST = f"""{SQL_STATES}, latest AS (
  SELECT item_id, state, event_id FROM states
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, event_id DESC) = 1)"""
_TERMINAL = ", ".join(f"'{s}'" for s in TERMINAL_STATES)


@query("latest_checkpoint", f"WITH {SQL_LATEST} SELECT item_id, state, event_id FROM latest")
def latest_checkpoint_query(spark, sf_dir):
    return latest_checkpoint(states(spark, sf_dir)).drop("ts")


@query("terminal_items", f"WITH {SQL_LATEST} SELECT item_id, state, event_id FROM latest WHERE state IN ({_TERMINAL})")
def terminal_items_query(spark, sf_dir):
    return terminal_items(latest_checkpoint(states(spark, sf_dir))).drop("ts")


@query(
    "resume_plan",
    f"""WITH {SQL_LATEST} SELECT item_id, state AS last_state, CASE WHEN state = 'init' THEN 'preprocess' ELSE state END AS restart_at,
       state <> 'init' AS skip_preprocess FROM latest WHERE state NOT IN ({_TERMINAL})""",
)
def resume_plan_query(spark, sf_dir):
    return resume_plan(states(spark, sf_dir))


def messages(spark, sf_dir):
    """Views as requests and clicks as responses of one kind, the user as correlation id."""
    return message_rows(table(spark, sf_dir, "events"))


def message_rows(events):
    kind = (
        F.when(F.col("event_type") == "view", "check.request")
        .when(F.col("event_type") == "click", "check.response")
        .otherwise(F.col("event_type"))
    )
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("type"),
        F.col("user_id").cast("string").alias("correlation_id"),
    )


SQL_MESSAGES = """messages AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS correlation_id,
         CASE event_type WHEN 'view' THEN 'check.request' WHEN 'click' THEN 'check.response' ELSE event_type END AS type FROM events)"""


@query(
    "topic_filter",
    f"WITH {SQL_MESSAGES} SELECT event_id, type, correlation_id FROM messages WHERE type IN ('check.request', 'signup')",
)
def topic_filter_query(spark, sf_dir):
    return topic_filter(messages(spark, sf_dir), ["check.request", "signup"]).drop("ts")


@query(
    "delivered_counts",
    f"""WITH {SQL_MESSAGES}, subs AS (
  SELECT DISTINCT user_id, CASE event_type WHEN 'view' THEN 'check.request' ELSE event_type END AS topic
  FROM events WHERE value > 15 AND event_type <> 'click'),
per_topic AS (SELECT topic, count(*) AS delivered FROM subs GROUP BY topic)
SELECT event_id, type, coalesce(delivered, 0) AS delivered FROM messages LEFT JOIN per_topic ON type = topic""",
)
def delivered_counts_query(spark, sf_dir):
    topic = F.when(F.col("event_type") == "view", "check.request").otherwise(F.col("event_type"))
    subs = (
        table(spark, sf_dir, "events")
        .where("value > 15 and event_type <> 'click'")
        .select("user_id", topic.alias("topic"))
        .distinct()
    )
    return delivered_counts(messages(spark, sf_dir), subs).select("event_id", "type", "delivered")


TIMEOUT_MS = 6 * 3600 * 1000
SQL_PAIRED = f"""WITH {SQL_MESSAGES},
pairs AS (
  SELECT q.event_id, q.correlation_id, r.event_id AS response_id
  FROM messages q LEFT JOIN messages r
    ON r.type = 'check.response' AND q.correlation_id = r.correlation_id
   AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL {TIMEOUT_MS // 1000} SECOND
  WHERE q.type = 'check.request'
  QUALIFY row_number() OVER (PARTITION BY q.event_id ORDER BY r.ts, r.event_id) = 1)
SELECT event_id, correlation_id, response_id,
       CASE WHEN response_id IS NULL THEN 'timed-out' ELSE 'answered' END AS status FROM pairs"""


@query("request_response", SQL_PAIRED)
def request_response_query(spark, sf_dir):
    paired = request_response(messages(spark, sf_dir), "check", TIMEOUT_MS)
    return paired.select("event_id", "correlation_id", "response_id", "status")
