"""Wordlist and blocklist tables, item reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftgate.plans.scratch import scratch_path
from siftgate.queries.base import SQL_BLOCKLIST, blocklist, query, seeds, table
from siftgate.sources.blocklist import blocklist_counts, load_blocklist
from siftgate.sources.image_heads import write_files
from siftgate.sources.items import read_items
from siftgate.sources.tables import spread
from siftgate.sources.wordlist import validate_wordlist, wordlist_category_counts, wordlist_terms


@query("load_blocklist", f"WITH {SQL_BLOCKLIST} SELECT hash, kind FROM blocklist")
def load_blocklist_query(spark, sf_dir):
    """Seed objects as lines of JSON files in the shared folder, read back."""
    path = scratch_path(spark, "seeds")
    seeds(spark, sf_dir).write.json(path)
    return load_blocklist(spark, path, multi_line=False)


@query("blocklist_counts", f"WITH {SQL_BLOCKLIST} SELECT kind, count(*) AS n FROM blocklist GROUP BY kind")
def blocklist_counts_query(spark, sf_dir):
    return blocklist_counts(blocklist(spark, sf_dir))


# Parts as raw wordlist entries, some of them broken.
_RAW = """CAST(p_partkey AS INT) AS entry_no,
  CASE WHEN p_size % 10 = 1 THEN '' WHEN p_size % 10 = 2 THEN NULL ELSE p_name END AS word,
  CASE WHEN p_size % 10 = 3 THEN '' ELSE p_type END AS category,
  CASE WHEN p_size % 10 = 4 THEN NULL ELSE p_brand END AS severity,
  CASE WHEN p_size % 10 = 5 THEN 'glob' WHEN p_size % 10 = 6 THEN 'regex' WHEN p_size % 10 = 7 THEN 'exact' END AS match"""
_CHECKED = f"""WITH raw AS (SELECT {_RAW} FROM part),
checked AS (
  SELECT *, CASE WHEN match NOT IN ('exact', 'regex') THEN 'invalid match'
    WHEN word IS NULL OR word = '' THEN 'missing word'
    WHEN category IS NULL OR category = '' THEN 'missing category'
    WHEN severity IS NULL OR severity = '' THEN 'missing severity' END AS error
  FROM raw)"""


def raw_wordlist(spark, sf_dir):
    columns = [c.strip() for c in _RAW.split(",\n")]
    return table(spark, sf_dir, "part").selectExpr(*columns)


def valid_wordlist(spark, sf_dir):
    return validate_wordlist(raw_wordlist(spark, sf_dir)).where("error is null").drop("error")


@query("validate_wordlist", f"{_CHECKED} SELECT entry_no, word, category, severity, match, error FROM checked")
def validate_wordlist_query(spark, sf_dir):
    return validate_wordlist(raw_wordlist(spark, sf_dir))


@query("wordlist_terms", f"{_CHECKED} SELECT DISTINCT word FROM checked WHERE error IS NULL")
def wordlist_terms_query(spark, sf_dir):
    return wordlist_terms(valid_wordlist(spark, sf_dir))


@query(
    "wordlist_category_counts",
    f"{_CHECKED} SELECT category, count(*) AS n FROM checked WHERE error IS NULL GROUP BY category",
)
def wordlist_category_counts_query(spark, sf_dir):
    return wordlist_category_counts(valid_wordlist(spark, sf_dir))


@query(
    "read_items",
    """SELECT CAST(page_id AS VARCHAR) AS item_id, octet_length(encode(html)) AS n_bytes, md5(html) AS md5 FROM pages""",
)
def read_items_query(spark, sf_dir):
    """Pages as one file each in the shared folder, read back as items."""
    folder = scratch_path(spark, "pages")
    name = F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name")
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    write_files(pages.select(name, F.col("html").cast("binary").alias("content")), folder)
    found = read_items(spark, folder)
    item = F.regexp_extract("item_id", "([0-9]+)\\.html$", 1).alias("item_id")
    return found.select(item, F.octet_length("content").cast("bigint").alias("n_bytes"), F.md5("content").alias("md5"))
