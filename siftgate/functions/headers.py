"""Facts from PNG and JPEG headers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Channel count by PNG colour type.
_PNG_CHANNELS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}

_SIZE = StructType([StructField("width", IntegerType()), StructField("height", IntegerType())])


def _number(c: Column, at: int, length: int) -> Column:
    """Big-endian unsigned number of `length` bytes at byte offset `at`."""
    return F.conv(F.hex(F.substring(c, at + 1, length)), 16, 10).cast("bigint")


def _frame_size(data: bytes) -> dict[str, int] | None:
    """Width and height from the first baseline or progressive frame header."""
    at, last = 2, len(data) - 8
    while at < last:
        at = data.find(b"\xff", at, last)
        if at < 0:
            return None
        kind = data[at + 1]
        if 0xD0 <= kind <= 0xD9:  # restart, start and end markers carry no length
            at += 2
        elif kind in (0xC0, 0xC2):
            return {
                "height": int.from_bytes(data[at + 5 : at + 7], "big"),
                "width": int.from_bytes(data[at + 7 : at + 9], "big"),
            }
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


@F.arrow_udf(_SIZE)
def _jpeg_size(values: pa.Array) -> pa.Array:
    sizes = [None if v is None else _frame_size(v) for v in values.to_pylist()]
    return pa.array(sizes, pa.struct([("width", pa.int32()), ("height", pa.int32())]))


def _is_png(c: Column) -> Column:
    return (F.octet_length(c) >= 24) & (F.hex(F.substring(c, 1, 4)) == "89504E47")


def _is_jpeg(c: Column) -> Column:
    return (F.octet_length(c) >= 4) & (F.hex(F.substring(c, 1, 2)) == "FFD8")


def jpeg_size(c: Column) -> Column:
    """Only JPEG bytes cross into Python; everything else goes over as null."""
    return _jpeg_size(F.when(_is_jpeg(c), c))


def header_facts(c: Column, jpeg: Column) -> Column:
    """struct<format,width,height,channels,has_alpha>, null when the bytes are no image.

    `jpeg` is the column made by `jpeg_size` in an earlier projection.
    """
    colour = _number(c, 25, 1).cast("int")
    channels = F.lit(4)
    for kind, count in _PNG_CHANNELS.items():
        channels = F.when(colour == kind, F.lit(count)).otherwise(channels)
    alpha = F.coalesce(colour.isin(4, 6) | ~colour.isin(*_PNG_CHANNELS), F.lit(True))

    def facts(kind: str, width: Column, height: Column, n: Column, has_alpha: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("format"),
            width.cast("bigint").alias("width"),
            height.cast("bigint").alias("height"),
            n.cast("int").alias("channels"),
            has_alpha.alias("has_alpha"),
        )

    return F.when(
        _is_png(c), facts("png", _number(c, 16, 4), _number(c, 20, 4), channels, alpha)
    ).when(
        jpeg.isNotNull(),
        facts("jpeg", jpeg["width"], jpeg["height"], F.lit(3), F.lit(False)),
    )
