"""Fingerprint, blocklist lookup and header facts of every item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgate.functions.hashing import byte_grid_hash, md5_hex
from siftgate.functions.headers import header_facts, jpeg_size
from siftgate.operators.blocklist import blocklist_lookup

OK, FAILED, HIT = "ok", "preprocess-failed", "blocklist-hit"


def with_facts(items: DataFrame) -> DataFrame:
    """Add md5, phash, header. Missing bytes count as empty bytes."""
    content = F.coalesce("content", F.lit(b""))
    return (
        items.withColumn("md5", md5_hex(content))
        .withColumn("phash", byte_grid_hash(content))
        .withColumn("__jpeg", jpeg_size(content))
        .withColumn("header", header_facts(content, F.col("__jpeg")))
        .drop("__jpeg")
    )


def preprocess_status(hit_kind: Column, header: Column) -> list[Column]:
    """Columns status, preprocess_score, format, width, height."""
    hit = hit_kind.isNotNull()
    known = ~hit & header.isNotNull()
    return [
        F.when(hit, HIT).when(known, OK).otherwise(FAILED).alias("status"),
        F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0)).alias("preprocess_score"),
        F.when(known, header["format"]).otherwise("unknown").alias("format"),
        F.when(known, header["width"]).otherwise(F.lit(0)).cast("bigint").alias("width"),
        F.when(known, header["height"]).otherwise(F.lit(0)).cast("bigint").alias("height"),
    ]


def preprocess_items(items: DataFrame, blocklist: DataFrame) -> DataFrame:
    """One narrow row per item: fingerprints, hit, status, image facts.

    The bytes are dropped before the lookup, so whatever the lookup's join does, it
    moves hashes only.
    """
    facts = with_facts(items.select("item_id", "content")).drop("content")
    looked = blocklist_lookup(facts, blocklist)
    return looked.select(
        "item_id", "md5", "phash", "hit_hash", "hit_kind",
        *preprocess_status(F.col("hit_kind"), F.col("header")),
    )
