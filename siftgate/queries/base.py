"""Registry, inputs and the constants shared by the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgate.constants import WHITESPACE
from siftgate.functions.hashing import byte_grid_hash
from siftgate.operators.matching import Entry
from siftgate.plans.scratch import written
from siftgate.sources.blocklist import blocklist_entries
from siftgate.sources.items import items_from
from siftgate.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_key():
    return F.col("doc_id").cast("string").alias("item_id")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id and text, the input of CPU-bound work on whole texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(item_key(), "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: their UTF-8 bytes are the content, their text the read text."""
    return document_items(documents(spark, sf_dir))


def document_items(docs: DataFrame) -> DataFrame:
    return items_from(docs, "doc_id", content=F.col("text").cast("binary"), ocr_text=F.col("text"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed objects, one per labelled document: the MD5 of toxic ones in upper case, the
    grid hash of those of low quality; the other list is missing."""
    labels = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = docs.join(labels, "doc_id").withColumn("phash", byte_grid_hash(F.col("text").cast("binary")))
    return marked.select(
        F.when(F.col("toxic") == 1, F.array(F.upper(F.md5("text")))).alias("md5"),
        F.when(F.col("quality") == 0, F.array("phash")).alias("phash_seed"),
    )


_blocklists: dict[tuple[str, str], DataFrame] = {}


def blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocklist as a stored table, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _blocklists:
        _blocklists[key] = written(blocklist_entries(seeds(spark, sf_dir)), "blocklist")
    return _blocklists[key]


# A small example wordlist for the driver's documents. Entry 7 repeats entry 1 in other
# case, so it never reports; entry 8 holds a space and cannot match stripped text.
ENTRIES = [
    Entry("free", "promotion", "一般错误"),
    Entry("license", "legal", "提示", "exact"),
    Entry("public", "legal", "提示"),
    Entry("@mail[0-9]+", "contact", "原则性错误", "regex"),
    Entry("und", "filler", "提示"),
    Entry("que", "filler", "一般错误"),
    Entry("FREE", "shouting", "原则性错误"),
    Entry("the same", "phrase", "提示"),
]

# ---- SQL pieces -------------------------------------------------------------------

SQL_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS item_id, text FROM documents)"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_WS = sql_text(WHITESPACE + "+")
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + chr(0x3000)
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def sql_narrow(x: str) -> str:
    return f"translate({x}, {sql_text(_WIDE)}, {sql_text(_NARROW)})"


def sql_ascii_lower(x: str) -> str:
    return f"translate({x}, '{_AZ}', '{_AZ.lower()}')"


def sql_normalize(x: str, mode: str) -> str:
    mapped = sql_ascii_lower(sql_narrow(x))
    if mode == "preserve":
        return mapped
    if mode == "strip":
        return f"regexp_replace({mapped}, {SQL_WS}, '', 'g')"
    return f"trim(regexp_replace({mapped}, {SQL_WS}, ' ', 'g'), ' ')"


def sql_match_text(x: str) -> str:
    return f"lower({sql_normalize(x, 'strip')})"


def sql_clamp01(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR ({x}) < 0 THEN 0e0 WHEN ({x}) > 1 THEN 1e0 ELSE ({x}) END)"


def sql_clamp_unit(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR NOT isfinite({x}) OR ({x}) < 0 THEN 0e0 WHEN ({x}) > 1 THEN 1e0 ELSE ({x}) END)"


# Grid hash of documents: cells are cut as slices of the hex form, bytes summed per slice.
SQL_PHASH = """hexed AS (
  SELECT CAST(doc_id AS VARCHAR) AS item_id, md5(text) AS md5, hex(encode(text)) AS h,
         octet_length(encode(text)) AS n, greatest(1, octet_length(encode(text)) // 64) AS w
  FROM documents),
cut AS (
  SELECT item_id, n, w, k, substr(h, 2 * k * w + 1, 2 * w) AS s
  FROM hexed, range(64) AS r(k)),
cell AS (
  SELECT item_id, k, CASE WHEN k * w >= n THEN 128 ELSE
    list_sum(list_transform(range(w), lambda i: CAST('0x' || substr(s, 2 * i + 1, 2) AS INTEGER))) // w END AS v
  FROM cut),
bit AS (
  SELECT item_id, k, CASE WHEN 64 * v > sum(v) OVER (PARTITION BY item_id) THEN 1 ELSE 0 END AS b FROM cell),
digit AS (
  SELECT item_id, k // 4 AS d, CAST(sum(b * CASE k % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END) AS INTEGER) AS x
  FROM bit GROUP BY 1, 2),
hashed AS (
  SELECT item_id, string_agg(substr('0123456789abcdef', x + 1, 1), '' ORDER BY d) AS phash FROM digit GROUP BY 1),
prints AS (SELECT item_id, md5, phash, n FROM hexed JOIN hashed USING (item_id))"""

SQL_BLOCKLIST = SQL_PHASH + """,
blocklist AS (
  SELECT DISTINCT md5 AS hash, 'md5' AS kind FROM prints JOIN labels ON item_id = CAST(doc_id AS VARCHAR) WHERE toxic = 1
  UNION
  SELECT DISTINCT phash, 'phash' FROM prints JOIN labels ON item_id = CAST(doc_id AS VARCHAR) WHERE quality = 0),
looked AS (
  SELECT p.*, coalesce(m.hash, g.hash) AS hit_hash,
         CASE WHEN m.hash IS NOT NULL THEN 'md5' WHEN g.hash IS NOT NULL THEN 'phash' END AS hit_kind
  FROM prints p
  LEFT JOIN (SELECT * FROM blocklist WHERE kind = 'md5') m ON p.md5 = m.hash
  LEFT JOIN (SELECT * FROM blocklist WHERE kind = 'phash') g ON p.phash = g.hash)"""


def sql_entries() -> str:
    rows = ", ".join(
        f"({no}, {sql_text(e.word)}, {sql_text(e.category)}, {sql_text(e.severity)}, "
        f"{sql_text(e.match) if e.match else 'NULL'})"
        for no, e in enumerate(ENTRIES, 1)
    )
    return f"listed(entry_no, word, category, severity, match) AS (VALUES {rows})"


SQL_MATCHES = f"""{SQL_DOCS}, {sql_entries()},
wordlist AS (
  SELECT *, coalesce(match, 'exact') AS kind FROM listed
  QUALIFY row_number() OVER (PARTITION BY coalesce(match, 'exact'), lower(word) ORDER BY entry_no) = 1),
normal AS (SELECT item_id, {sql_match_text('text')} AS t FROM docs),
found AS (
  SELECT item_id, word, category, severity, kind,
         CASE WHEN kind = 'regex' THEN regexp_extract(t, word) ELSE lower(word) END AS hit, t
  FROM normal, wordlist
  WHERE CASE WHEN kind = 'regex' THEN regexp_matches(t, word) ELSE contains(t, lower(word)) END),
matches AS (
  SELECT item_id, word, category, severity, CAST(strpos(t, hit) - 1 AS INTEGER) AS "start",
         CAST(strpos(t, hit) - 1 + length(hit) AS INTEGER) AS "end", kind AS match
  FROM found)"""

SQL_SEVERITY = SQL_MATCHES + """,
counts AS (
  SELECT d.item_id, count(*) FILTER (severity = '原则性错误') AS n1, count(*) FILTER (severity = '一般错误') AS n2,
         count(*) FILTER (severity = '提示') AS n3, count(m.word) AS n
  FROM docs d LEFT JOIN matches m USING (item_id) GROUP BY 1),
severity AS (
  SELECT item_id, n, 4e-1 * (CASE WHEN n1 > 0 THEN 1e0 WHEN n2 > 0 THEN 6e-1 WHEN n3 > 0 THEN 2e-1 ELSE 0e0 END)
         + 6e-1 * least(1e0, (n1 * 1e0 + n2 * 6e-1 + n3 * 2e-1) / 3e0) AS text_score
  FROM counts)"""
