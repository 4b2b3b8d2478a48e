"""Header facts of image bytes and their inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgate.functions.headers import header_facts, jpeg_size


def image_header(items: DataFrame, content: str = "content") -> DataFrame:
    """Add `header`: struct<format,width,height,channels,has_alpha>, null when unknown."""
    return (
        items.withColumn("__jpeg", jpeg_size(F.col(content)))
        .withColumn("header", header_facts(F.col(content), F.col("__jpeg")))
        .drop("__jpeg")
    )


def image_inventory(items: DataFrame, content: str = "content") -> DataFrame:
    """Items per format and size."""
    facts = image_header(items, content).select(
        F.coalesce("header.format", F.lit("unknown")).alias("format"),
        F.coalesce("header.width", F.lit(0)).alias("width"),
        F.coalesce("header.height", F.lit(0)).alias("height"),
        F.octet_length(content).cast("bigint").alias("bytes"),
    )
    return facts.groupBy("format", "width", "height").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")
    )
