"""Screening, audit, latest state and deduplication on streams.

Every function starts a query and returns it. Checkpoints belong in the shared folder.
Keyed state can outgrow executor memory: set `keyed.STATE_STORE` on the session before starting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siftgate.operators.fusion import DEFAULT_FUSION, FusionConfig
from siftgate.operators.matching import WordlistIndex
from siftgate.operators.scorers import Scorer
from siftgate.operators.states import ORDER
from siftgate.plans.joins import is_small
from siftgate.plans.screen import audit_events, screen
from siftgate.sources.audit_log import audit_lines

def file_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    """A stream over files. A single file is given as a pattern, as the source lists folders."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def _append(stream: DataFrame, sink: str, checkpoint: str, trigger: Mapping) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def stream_screen(
    items: DataFrame,
    blocklist: DataFrame,
    sink: str,
    checkpoint: str,
    slots: Mapping[str, Scorer] | None = None,
    config: FusionConfig = DEFAULT_FUSION,
    trigger: Mapping = {"availableNow": True},
    wordlist: DataFrame | None = None,
) -> StreamingQuery:
    """Screen items as they arrive. Stateless; blocklist and wordlist are static sides, and the
    wordlist must be within the bounds of a search table."""
    return _append(screen(items, blocklist, slots, config, wordlist=_index(wordlist)), sink, checkpoint, trigger)


def _index(wordlist: DataFrame | None) -> WordlistIndex | None:
    if wordlist is None:
        return None
    index = WordlistIndex.of(wordlist)
    if index is None:
        raise ValueError("the wordlist is too large for a stream: screen in batches, which join it")
    return index


def _write_result_and_audit(
    batch: DataFrame, batch_id: int, blocklist, fits, slots, config, wordlist, result_path: str, audit_path: str
) -> None:
    spark = batch.sparkSession
    result = f"{result_path}/batch_id={batch_id}"
    screen(batch, blocklist, slots, config, blocklist_fits=fits, wordlist=wordlist).write.mode("overwrite").parquet(result)
    # The audit is taken from the written result, so both tell the same story.
    audit = audit_events(spark.read.parquet(result))
    audit_lines(audit).write.mode("overwrite").json(
        f"{audit_path}/batch_id={batch_id}", ignoreNullFields=False
    )


def stream_audit(
    items: DataFrame,
    blocklist: DataFrame,
    result_path: str,
    audit_path: str,
    checkpoint: str,
    slots: Mapping[str, Scorer] | None = None,
    config: FusionConfig = DEFAULT_FUSION,
    trigger: Mapping = {"availableNow": True},
    wordlist: DataFrame | None = None,
) -> StreamingQuery:
    """Screen and write results and audit lines per batch. A repeated batch overwrites its
    own folders, so nothing is counted twice."""
    write = partial(
        _write_result_and_audit,
        blocklist=blocklist,
        fits=is_small(blocklist),
        slots=slots,
        config=config,
        wordlist=_index(wordlist),
        result_path=result_path,
        audit_path=audit_path,
    )
    return (
        items.writeStream.foreachBatch(lambda batch, batch_id: write(batch, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_latest_state(
    events: DataFrame,
    sink: str,
    checkpoint: str,
    key: str = "item_id",
    order: Sequence[str] = ORDER,
    state: str = "state",
    trigger: Mapping = {"availableNow": True},
) -> StreamingQuery:
    """Newest state per key, kept as running state; each batch writes the keys it changed."""
    newest = F.max_by(F.struct(state, *order), F.struct(*order)).alias("c")
    latest = events.groupBy(key).agg(newest).select(key, *[f"c.{c}" for c in (state, *order)])

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        latest.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_dedup(
    items: DataFrame,
    sink: str,
    checkpoint: str,
    keys: Sequence[str] = ("md5",),
    event_time: str = "ts",
    lateness: str = "1 day",
    trigger: Mapping = {"availableNow": True},
) -> StreamingQuery:
    """Drop repeat uploads that arrive within the lateness of the first one."""
    unique = items.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))
    return _append(unique, sink, checkpoint, trigger)
