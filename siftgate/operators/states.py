"""Event tables of screening runs: legal steps, checkpoints, what is left to do."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgate.constants import MAIN_PATH, TERMINAL_STATES, TRANSITIONS
from siftgate.operators.ordering import previous_in_key
from siftgate.plans.joins import lookup_join

ORDER = ("ts", "event_id")


def transition_table(spark: SparkSession, extra: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Legal steps (from_state, to_state); `extra` adds further allowed ones."""
    steps = sorted({*TRANSITIONS, *extra})
    return spark.createDataFrame(steps, "from_state string, to_state string")


def check_transitions(
    events: DataFrame,
    allowed: DataFrame,
    key: str = "item_id",
    order: Sequence[str] = ORDER,
    state: str = "state",
) -> DataFrame:
    """Rows whose step from the key's previous state is not allowed."""
    stepped = previous_in_key(events.select(key, *order, state), key, order, state, "from_state")
    steps = stepped.where(F.col("from_state").isNotNull()).withColumnRenamed(state, "to_state")
    return lookup_join(
        steps, allowed.select("from_state", "to_state").distinct(), ["from_state", "to_state"], "left_anti", order
    ).select(key, *order, "from_state", "to_state")


def next_state(state: Column) -> Column:
    """The following state on the main path; null after the last and off the path."""
    pairs = [F.lit(s) for step in zip(MAIN_PATH, MAIN_PATH[1:]) for s in step]
    return F.try_element_at(F.create_map(*pairs), state)


def latest_checkpoint(
    events: DataFrame, key: str = "item_id", order: Sequence[str] = ORDER, state: str = "state"
) -> DataFrame:
    """Newest state per key. One partial row per key and task goes into the shuffle."""
    newest = F.max_by(F.struct(state, *order), F.struct(*order)).alias("c")
    return events.groupBy(key).agg(newest).select(key, *[f"c.{c}" for c in (state, *order)])


def terminal_items(checkpoints: DataFrame, state: str = "state") -> DataFrame:
    return checkpoints.where(F.col(state).isin(*TERMINAL_STATES))


def resume_plan(
    events: DataFrame, key: str = "item_id", order: Sequence[str] = ORDER, state: str = "state"
) -> DataFrame:
    """Unfinished keys with the stage to restart from. The preprocess stage is skipped
    when its output was already stored, i.e. for any state after init."""
    last = latest_checkpoint(events, key, order, state)
    return last.where(~F.col(state).isin(*TERMINAL_STATES)).select(
        key,
        F.col(state).alias("last_state"),
        F.when(F.col(state) == "init", "preprocess").otherwise(F.col(state)).alias("restart_at"),
        (F.col(state) != "init").alias("skip_preprocess"),
    )
