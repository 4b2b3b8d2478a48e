"""Items to screen: (item_id, content, ocr_text, bboxes, exif), all but the id nullable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = {
    "content": "binary",
    "ocr_text": "string",
    "bboxes": "array<string>",
    "exif": "map<string,string>",
}


def items_from(df: DataFrame, item_id: str | Column, **columns: Column) -> DataFrame:
    """Shape any table into items; columns not given are null."""
    unknown = set(columns) - set(COLUMNS)
    if unknown:
        raise ValueError(f"unknown item columns: {sorted(unknown)}")
    key = F.col(item_id) if isinstance(item_id, str) else item_id
    return df.select(
        key.cast("string").alias("item_id"),
        *[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in COLUMNS.items()],
    )


def read_items(spark: SparkSession, path: str, fmt: str = "binaryFile") -> DataFrame:
    """Read items. binaryFile: one item per file, the path is the id. Other formats: a
    table that has item_id and any of the item columns.

    The bytes are only read when a later step uses `content`.
    """
    raw = spark.read.format(fmt).load(path)
    if fmt == "binaryFile":
        return items_from(raw, "path", content=F.col("content"))
    present = {name: F.col(name) for name in COLUMNS if name in raw.columns}
    return items_from(raw, "item_id", **present)
