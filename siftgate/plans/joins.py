"""Joins of a big table with a lookup table whose size is checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A lookup table is broadcast up to both bounds. The driver holds it as rows, as a hash table and as sent blocks at once.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 10_000_000
SALTS = 16


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the table holds at most `max_rows` rows and, spelled as JSON, `max_bytes`
    bytes. Reads no further than that many rows."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def large_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join of tables that both grow with the input, sorted on both sides.

    Spark would broadcast by the weight of compressed files or shuffled blocks: 10 MB of those are a
    million short rows, which as hash tables, several at a time, are too much for a small driver.
    """
    return left.join(right.hint("merge"), on, how)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    salt_by: Sequence[str] = (),
    max_rows: int = BROADCAST_ROWS,
    small_fits: bool | None = None,
) -> DataFrame:
    """Join on equal keys; `small` has each key once or few times.

    While `small` is within the bound it is broadcast and `big` does not move. Beyond it
    the join shuffles, with the rows of one key spread over SALTS tasks by `salt_by`, so
    a key held by a large part of `big` does not end up in one task.
    """
    on = list(on)
    if small_fits is None:
        small_fits = is_small(small, max_rows)
    if small_fits:
        return big.join(F.broadcast(small), on, how)
    spread = [F.col(c) for c in (salt_by or big.columns)]
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large_join(salted, copies, [*on, "__salt"], how).drop("__salt")
