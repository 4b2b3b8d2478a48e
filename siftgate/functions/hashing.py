"""Byte fingerprints: MD5, the 64-cell grid hash, and Hamming distance of hex hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CELLS = 64
_BLOCK_BYTES = 8 << 20


def md5_hex(c: Column) -> Column:
    return F.md5(c)


def _grid_cells(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Integer cell means of byte strings lying back to back in `data`, one row each."""
    starts, lengths = offsets[:-1], np.diff(offsets)
    cells = np.full((len(lengths), CELLS), 128, dtype=np.int64)
    long = lengths >= CELLS
    if long.any():
        width = lengths[long] // CELLS
        # 65 cut points per row; the last span (tail bytes past 64*width) is dropped.
        cuts = starts[long, None] + width[:, None] * np.arange(CELLS + 1)
        padded = np.append(data, np.uint8(0))
        sums = np.add.reduceat(padded, cuts.ravel(), dtype=np.int64)
        cells[long] = sums.reshape(-1, CELLS + 1)[:, :CELLS] // width[:, None]
    short = ~long & (lengths > 0)
    if short.any():
        at = np.arange(CELLS)[None, :]
        inside = at < lengths[short, None]
        index = np.where(inside, starts[short, None] + at, 0)
        cells[short] = np.where(inside, data[index], 128)
    return cells


def _grid_hash_batch(values: pa.Array) -> list[str | None]:
    if pa.types.is_large_binary(values.type):
        values = values.cast(pa.binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[
        values.offset : values.offset + len(values) + 1
    ].astype(np.int64)
    raw = values.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(1, np.uint8)
    if len(data) == 0:
        data = np.zeros(1, np.uint8)
    out: list[str | None] = []
    row = 0
    while row < len(values):
        # Whole rows, at most about _BLOCK_BYTES at a time, to bound the work arrays.
        stop = int(np.searchsorted(offsets, offsets[row] + _BLOCK_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(values))
        base = offsets[row]
        cells = _grid_cells(data[base : max(offsets[stop], base + 1)], offsets[row : stop + 1] - base)
        bits = cells * CELLS > cells.sum(axis=1, keepdims=True)
        packed = np.packbits(bits, axis=1)
        out.extend(packed[i].tobytes().hex() for i in range(len(packed)))
        row = stop
    if values.null_count:
        valid = values.is_valid().to_pylist()
        out = [h if ok else None for h, ok in zip(out, valid)]
    return out


@F.arrow_udf(StringType())
def _grid_hash(values: pa.Array) -> pa.Array:
    return pa.array(_grid_hash_batch(values), pa.string())


def byte_grid_hash(c: Column) -> Column:
    """64-bit hash of bytes: the input is cut into 64 equal runs, a bit tells whether
    a run's mean lies above the mean of all runs. 16 hex digits.

    Higher-order functions would look at each byte in interpreted code, so this is one
    Arrow batch function over contiguous buffers.
    """
    return _grid_hash(c)


def byte_grid_hash_expr(c: Column) -> Column:
    """The same hash from built-in functions only; slow, kept to cross-check."""
    digits = F.hex(c)
    n = F.octet_length(c)
    width = F.greatest(F.lit(1), F.floor(n / CELLS).cast("int"))

    def byte_at(i: Column) -> Column:
        return F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def cell(k: Column) -> Column:
        start = k * width
        total = F.aggregate(
            F.sequence(F.lit(0), width - 1), F.lit(0), lambda acc, j: acc + byte_at(start + j)
        )
        return F.when(start >= n, F.lit(128)).otherwise(F.floor(total / width).cast("int"))

    cells = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell)
    total = F.aggregate(cells, F.lit(0), lambda acc, v: acc + v)
    bits = F.array_join(
        F.transform(cells, lambda v: F.when(v * CELLS > total, "1").otherwise("0")), ""
    )
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))


def hash_bits(c: Column) -> Column:
    """A hex hash of up to 16 digits as a signed 64-bit number. Other digits count as 0."""
    clean = F.regexp_replace(c, "[^0-9A-Fa-f]", "0")
    return F.coalesce(F.conv(clean, 16, -10).cast("bigint"), F.lit(0).cast("bigint"))


def hamming_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings of equal length; -1 when the lengths differ."""
    blocks = F.sequence(F.lit(0), F.floor((F.char_length(a) - 1) / 16).cast("int"))

    def block(i: Column) -> Column:
        return hamming_bits(
            hash_bits(F.substring(a, i * 16 + 1, F.lit(16))),
            hash_bits(F.substring(b, i * 16 + 1, F.lit(16))),
        )

    long = F.aggregate(blocks, F.lit(0), lambda acc, i: acc + block(i))
    return (
        F.when(F.char_length(a) != F.char_length(b), F.lit(-1))
        .when(F.char_length(a) <= 16, hamming_bits(hash_bits(a), hash_bits(b)))
        .otherwise(long)
    )
