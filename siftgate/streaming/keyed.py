"""Jobs with keyed state, event-time timers and expiry: request pairing and illegal steps.

State lives in the RocksDB store (set while a job starts), so it may outgrow memory. A key
has one value of state and one timer; when its state is used up both are deleted.

The watermark stays `lateness` behind the newest event. What arrives at or behind it is late and dropped;
everything else has the same effect in whatever order and batches it arrives.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from siftgate.operators.messages import DEFAULT_TIMEOUT_MS

# How far behind the newest event seen an event may arrive and still count.
DEFAULT_LATENESS = "1 hour"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}
# A correlation id's requests are held by blocks of so many timeouts, each a key of its own.
BLOCK_TIMEOUTS = 64
# Requests without a correlation id are spread over so many keys.
SALTS = 16


@contextmanager
def _state_store(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _started(rows: DataFrame, sink: str, checkpoint: str, trigger: Mapping) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    with _state_store(rows.sparkSession):
        return writer.outputMode("append").trigger(**trigger).start()


def _milliseconds(micros: int) -> int:
    return -(-micros // 1000)


class _Keyed(StatefulProcessor):
    """One state value and one timer per key. `settle` takes what the watermark allows out of the state."""

    fields: str

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{self.fields}, timer long")

    def take(self, held: list, row: Row) -> None:
        raise NotImplementedError

    def settle(self, key: tuple, held: list, watermark: int) -> tuple[list[Row], int | None]:
        """Result rows, and the time in microseconds at which something is due again. Changes held."""
        raise NotImplementedError

    def empty(self) -> list:
        raise NotImplementedError

    def _run(self, key, rows: Iterable[Row], watermark_ms: int):
        stored = self.state.get()
        held, timer = (list(stored[:-1]), stored[-1]) if stored else (self.empty(), None)
        held = [list(map(tuple, x)) if isinstance(x, list) else x for x in held]
        for row in rows:
            self.take(held, row)
        out, due = self.settle(key, held, watermark_ms * 1000)
        due = None if due is None else _milliseconds(due)
        if timer is not None and timer != due and timer > watermark_ms:
            self.handle.deleteTimer(timer)
        if due is not None and due != timer:
            self.handle.registerTimer(due)
        if held == self.empty():
            self.state.clear()
        else:
            self.state.update((*held, due))
        yield from out

    def handleInputRows(self, key, rows, timerValues):
        yield from self._run(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._run(key, (), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class FirstResponse(_Keyed):
    """Requests wait for the first response in time, which is known when the watermark has passed it."""

    def __init__(self, id_type: str, limit: int):
        self.limit = limit
        event = f"array<struct<us:long, event_id:{id_type}>>"
        self.fields = f"requests {event}, responses {event}"

    def empty(self) -> list:
        return [[], []]

    def take(self, held: list, row: Row) -> None:
        held[row.is_response].append((row.us, row.event_id))

    def settle(self, key, held, watermark):
        requests, responses = held
        responses.sort()
        times = [us for us, _ in responses]
        out, waiting, due = [], [], None
        for us, event_id in requests:
            at = bisect_left(times, us)
            answer = responses[at] if at < len(times) and times[at] <= us + self.limit else None
            known = answer[0] if answer else us + self.limit
            if known <= watermark:
                reply = answer or (None, None)
                out.append(Row(event_id=event_id, correlation_id=key[0], us=us, response_id=reply[1], response_us=reply[0]))
            else:
                waiting.append((us, event_id))
                due = known if due is None else min(due, known)
        # A request that is not late any more comes after the watermark: so does its answer.
        held[:] = waiting, responses[bisect_left(times, watermark + 1) :]
        if due is None and held[1]:
            due = held[1][-1][0]
        return out, due


def stream_request_response(
    events: DataFrame,
    base_type: str,
    sink: str,
    checkpoint: str,
    timeout_ms: int = DEFAULT_TIMEOUT_MS,
    lateness: str = DEFAULT_LATENESS,
    trigger: Mapping = {"availableNow": True},
) -> StreamingQuery:
    """One row per request, as `request_response` has it: the first response in time, or timed out.

    A row comes out once the watermark has passed the response or the end of the timeout; later answers
    are dropped and nothing is kept of them. A longer lateness holds more state and delays the rows by as much.
    """
    limit = timeout_ms * 1000
    block = limit * BLOCK_TIMEOUTS
    us = F.unix_micros("ts")
    talk = events.where(F.col("type").isin(f"{base_type}.request", f"{base_type}.response")).withWatermark("ts", lateness)
    talk = talk.select("event_id", "correlation_id", "ts", us.alias("us"), (F.col("type") == f"{base_type}.response").alias("is_response"))
    talk = talk.where(~F.col("is_response") | F.col("correlation_id").isNotNull())
    own = F.floor(F.col("us") / F.lit(block)).cast("long")
    # A response also goes to the block before its own when it may answer a request there.
    before = F.floor((F.col("us") - limit) / F.lit(block)).cast("long")
    blocks = F.when(F.col("is_response"), F.array_distinct(F.array(own, before))).otherwise(F.array(own))
    salt = F.when(F.col("correlation_id").isNull(), F.pmod(F.xxhash64("event_id"), F.lit(SALTS))).otherwise(0).cast("long")
    keyed = talk.withColumn("block", F.explode(blocks)).withColumn("salt", salt)
    id_type, c_type = (events.schema[c].dataType.simpleString() for c in ("event_id", "correlation_id"))
    out = keyed.groupBy("correlation_id", "block", "salt").transformWithState(
        FirstResponse(id_type, limit), f"event_id {id_type}, correlation_id {c_type}, us long, response_id {id_type}, response_us long", "append", "eventTime"
    )
    status = F.when(F.col("response_us").isNull(), "timed-out").otherwise("answered").alias("status")
    out = out.select(
        "event_id", "correlation_id", F.timestamp_micros("us").alias("ts"), "response_id", F.timestamp_micros("response_us").alias("response_ts"), status
    )
    return _started(out, sink, checkpoint, trigger)


class IllegalSteps(_Keyed):
    """Rows wait until the watermark has passed them and are then looked at in order, after the last one before."""

    def __init__(self, names: Sequence[str], types: Sequence[str], allowed: frozenset[tuple[str, str]]):
        self.names, self.allowed = names, allowed
        columns = ", ".join(f"{n}:{t}" for n, t in zip(("us", *names, "state"), ("long", *types, "string")))
        self.fields = f"waiting array<struct<{columns}>>, last string"

    def empty(self) -> list:
        return [[], None]

    def take(self, held: list, row: Row) -> None:
        held[0].append((row.us, *(row[n] for n in self.names), row.state))

    def settle(self, key, held, watermark):
        waiting, last = held
        waiting.sort(key=lambda r: r[:-1])
        out = []
        passed = bisect_left([r[0] for r in waiting], watermark + 1)
        for row in waiting[:passed]:
            if last is not None and (last, row[-1]) not in self.allowed:
                out.append(Row(key=key[0], us=row[0], **dict(zip(self.names, row[1:-1])), from_state=last, to_state=row[-1]))
            last = row[-1]
        held[:] = waiting[passed:], last
        return out, held[0][0][0] if held[0] else None


def stream_illegal_transitions(
    events: DataFrame,
    allowed: Iterable[tuple[str, str]],
    sink: str,
    checkpoint: str,
    key: str = "item_id",
    order: Sequence[str] = ("ts", "event_id"),
    state: str = "state",
    lateness: str = DEFAULT_LATENESS,
    trigger: Mapping = {"availableNow": True},
) -> StreamingQuery:
    """Alerts: the rows of `check_transitions`, each as soon as the watermark has passed it.

    `order` starts with the event time and tells a key's rows apart. Of a key stays the last
    state it was in; rows wait for at most the lateness. One key's rows are looked at by one task.
    """
    time, *names = order
    types = [events.schema[n].dataType.simpleString() for n in names]
    key_type = events.schema[key].dataType.simpleString()
    seen = events.withWatermark(time, lateness)
    seen = seen.select(F.col(key).alias("key"), time, F.unix_micros(time).alias("us"), *names, F.col(state).cast("string").alias("state"))
    columns = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    schema = f"key {key_type}, us long, {columns + ', ' if columns else ''}from_state string, to_state string"
    steps = seen.groupBy("key").transformWithState(IllegalSteps(names, types, frozenset(allowed)), schema, "append", "eventTime")
    out = steps.select(F.col("key").alias(key), F.timestamp_micros("us").alias(time), *names, "from_state", "to_state")
    return _started(out, sink, checkpoint, trigger)
