"""Wordlist tables: validation, terms, counts.

A wordlist is a table (entry_no, word, category, severity, match); entry_no keeps the
listed order, which decides between duplicates. match is exact (also when null) or regex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "entry_no int, word string, category string, severity string, match string"


def _missing(name: str):
    return F.col(name).isNull() | (F.col(name) == "")


def validate_wordlist(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Add `error`: null for a valid entry, else the first rule it breaks.

    With strict=True the first bad row fails the job when it is read.
    """
    error = (
        F.when(F.col("match").isNotNull() & ~F.col("match").isin("exact", "regex"), "invalid match")
        .when(_missing("word"), "missing word")
        .when(_missing("category"), "missing category")
        .when(_missing("severity"), "missing severity")
    )
    checked = raw.withColumn("error", error)
    if not strict:
        return checked
    failure = F.concat(F.lit("wordlist: entry "), F.col("entry_no").cast("string"), F.lit(": "), F.col("error"))
    return checked.withColumn(
        "error", F.when(F.col("error").isNotNull(), F.raise_error(failure)).cast("string")
    )


def read_wordlist(spark, path: str, fmt: str = "json", strict: bool = True) -> DataFrame:
    """Read a wordlist table with the fixed schema.

    With strict=True fields that a wordlist does not have are an error at once, and any
    invalid entry is one when it is read; else unknown fields are left out.
    """
    entries = validate_wordlist(spark.read.schema(SCHEMA).format(fmt).load(path), strict)
    if not strict:
        return entries.drop("error")
    unknown = set(spark.read.format(fmt).load(path).columns) - set(entries.columns)
    if unknown:
        raise ValueError(f"wordlist: unknown fields {sorted(unknown)}")
    # As a filter the check stays in the plan; a column that is dropped would not be computed.
    return entries.where(F.col("error").isNull()).drop("error")


def wordlist_terms(wordlist: DataFrame, collation: str | None = "zh_Hans_CHN") -> DataFrame:
    """Distinct words in locale order; collation=None gives binary order."""
    terms = wordlist.select("word").distinct()
    key = F.col("word") if collation is None else F.collate(F.col("word"), collation)
    return terms.orderBy(key)


def wordlist_category_counts(wordlist: DataFrame) -> DataFrame:
    return wordlist.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
