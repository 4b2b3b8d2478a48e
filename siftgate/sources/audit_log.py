"""Audit lines as JSON files, partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgate.constants import AUDIT_LEVEL, AUDIT_MESSAGE, AUDIT_PHASE

LINE_SCHEMA = (
    "timestamp timestamp, level string, phase string, message string, context struct<"
    "image_id:string,agent:string,score:double,reason:string,elapsed_ms:double>"
)
CORRUPT = "_corrupt_record"


def audit_lines(audit: DataFrame) -> DataFrame:
    """Wrap audit rows (item_id, agent, score, reason) in the fixed envelope.

    elapsed_ms stays null: rows of a batch have no time of their own.
    """
    return audit.select(
        F.current_timestamp().alias("timestamp"),
        F.lit(AUDIT_LEVEL).alias("level"),
        F.lit(AUDIT_PHASE).alias("phase"),
        F.lit(AUDIT_MESSAGE).alias("message"),
        F.struct(
            F.col("item_id").alias("image_id"),
            "agent",
            F.col("score").cast("double").alias("score"),
            "reason",
            F.lit(None).cast("double").alias("elapsed_ms"),
        ).alias("context"),
    )


def write_audit(audit: DataFrame, path: str) -> None:
    """Append one JSON line per audit row. Days become folders, so readers prune by day."""
    lines = audit_lines(audit).withColumn("dt", F.to_date("timestamp"))
    lines.write.mode("append").partitionBy("dt").json(path, ignoreNullFields=False)


def read_audit(spark: SparkSession, path: str, keep_corrupt: bool = True) -> DataFrame:
    """Audit rows back from the lines. Lines that hold no audit record are kept with their
    raw text in `_corrupt_record`, null otherwise; or left out, if asked for."""
    return lines_to_audit(spark.read.text(path), keep_corrupt)


def lines_to_audit(lines: DataFrame, keep_corrupt: bool) -> DataFrame:
    line = lines.select("value", F.from_json("value", LINE_SCHEMA).alias("line"))
    broken = F.col("line.message").isNull()
    rows = line.select(
        F.col("line.timestamp").alias("ts"),
        "line.level",
        "line.phase",
        "line.message",
        F.col("line.context.image_id").alias("item_id"),
        "line.context.agent",
        "line.context.score",
        "line.context.reason",
        "line.context.elapsed_ms",
        F.when(broken, F.col("value")).alias(CORRUPT),
    )
    return rows if keep_corrupt else rows.where(F.col("message").isNotNull()).drop(CORRUPT)


def audit_line_count(audit: DataFrame, by: str = "item_id") -> DataFrame:
    return audit.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def file_line_count(spark: SparkSession, path: str) -> DataFrame:
    """Raw line count per audit file, whatever the lines hold."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"))
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
