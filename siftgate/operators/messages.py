"""Published messages as a table: topics, deliveries, requests and responses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftgate.plans.joins import lookup_join

DEFAULT_TIMEOUT_MS = 5000


def topic_filter(events: DataFrame, types: str | Iterable[str]) -> DataFrame:
    """Messages of exactly these topics."""
    wanted = [types] if isinstance(types, str) else list(types)
    return events.where(F.col("type").isin(*wanted))


def delivered_counts(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Add `delivered`: subscriptions on the message's topic, 0 without any.

    Subscriptions are counted per topic first; messages never multiply.
    """
    per_topic = subscriptions.groupBy(F.col("topic").alias("type")).agg(F.count(F.lit(1)).alias("delivered"))
    joined = lookup_join(events, per_topic, ["type"], "left", ["event_id"])
    return joined.withColumn("delivered", F.coalesce("delivered", F.lit(0)))


def request_response(events: DataFrame, base_type: str, timeout_ms: int = DEFAULT_TIMEOUT_MS) -> DataFrame:
    """Requests `<base>.request` with the first `<base>.response` of the same correlation
    id within the timeout; without one the request timed out. Later responses are dropped.

    Time is cut into spans as long as the timeout, so a request's answer lies in its own
    span or the next. In its own span it is the next response by time; of the next span
    only the first response matters, one row per id and span. No request is paired
    with every response, and a busy correlation id is split over its spans. Requests
    without a correlation id time out.
    """
    span = timeout_ms * 1000
    at = F.unix_micros("ts")
    talk = topic_filter(events, [f"{base_type}.request", f"{base_type}.response"]).select(
        "event_id",
        "correlation_id",
        "ts",
        (F.col("type") == f"{base_type}.response").alias("is_response"),
        F.floor(at / F.lit(span)).cast("bigint").alias("span"),
    )
    reply = F.struct("ts", "event_id")
    backward = (
        Window.partitionBy("correlation_id", "span")
        .orderBy(F.desc("ts"), F.desc("is_response"), F.desc("event_id"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    paired = F.col("is_response") & F.col("correlation_id").isNotNull()
    following = F.last(F.when(paired, reply), ignorenulls=True).over(backward)
    requests = talk.withColumn("same_span", following).where(~F.col("is_response"))
    firsts = (
        talk.where("is_response")
        .groupBy("correlation_id", (F.col("span") - 1).alias("span"))
        .agg(F.min(reply).alias("next_span"))
    )
    joined = requests.join(firsts, ["correlation_id", "span"], "left")
    in_time = F.unix_micros("next_span.ts") - F.unix_micros("ts") <= span
    answer = F.coalesce("same_span", F.when(in_time, F.col("next_span")))
    return joined.withColumn("answer", answer).select(
        "event_id",
        "correlation_id",
        "ts",
        F.col("answer.event_id").alias("response_id"),
        F.col("answer.ts").alias("response_ts"),
        F.when(F.col("answer").isNull(), "timed-out").otherwise("answered").alias("status"),
    )
