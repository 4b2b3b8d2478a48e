"""Blocklist seed files: JSON objects {"md5": [...], "phash_seed": [...]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED_SCHEMA = "md5 array<string>, phash_seed array<string>"


def blocklist_entries(seeds: DataFrame) -> DataFrame:
    """(hash, kind) rows of seed objects: lower-case, distinct; a missing list is empty."""
    both = seeds.select(
        F.explode(
            F.concat(
                F.transform(
                    F.coalesce("md5", F.array().cast("array<string>")),
                    lambda h: F.struct(F.lower(h).alias("hash"), F.lit("md5").alias("kind")),
                ),
                F.transform(
                    F.coalesce("phash_seed", F.array().cast("array<string>")),
                    lambda h: F.struct(F.lower(h).alias("hash"), F.lit("phash").alias("kind")),
                ),
            )
        ).alias("entry")
    )
    return both.select("entry.hash", "entry.kind").distinct()


def load_blocklist(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Seed files to entries. multi_line: one object per file; else one object per line."""
    raw = spark.read.schema(SEED_SCHEMA).json(path, multiLine=multi_line)
    return blocklist_entries(raw)


def blocklist_counts(blocklist: DataFrame) -> DataFrame:
    return blocklist.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
