"""The registered queries: thin digests of the operators' own outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgate.llm import pii, sql
from siftgate.llm.ann import nearest
from siftgate.llm.bpe import round_trip
from siftgate.llm.embed_dedup import near_duplicates as embed_near_duplicates
from siftgate.llm.hard_negatives import hard_negatives
from siftgate.llm.html_text import main_text
from siftgate.llm.mixing import taken_words
from siftgate.llm.quality import THRESHOLD, fit, held_out, scorer
from siftgate.llm.prefix_trie import prefix_trie, rebuilt, turns
from siftgate.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401
from siftgate.llm.secret_scan import BASE_KINDS, count_kind, spelled, with_secrets
from siftgate.llm.simhash import near_duplicates
from siftgate.llm.suffix_dedup import remove_repeats
from siftgate.llm.warc import read_archive, write_archive
from siftgate.plans.scratch import scratch_path


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    both = round_trip(spark, path or public_tokenizers.path("byte_bpe_50k.json"))
    encoded = table(spark, sf_dir, "documents").select("doc_id", both(F.col("text")).alias("both"))
    return encoded.select("doc_id", "both.*").select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op2_quality")
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = scorer(docs, fit(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_kind(F.col("base"), k).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


@query("op3_mixing", sql.MIX)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY b) AS kept, sha1(b) AS h FROM p),
bits AS (
  SELECT *, list_aggregate(list_transform(range(40), lambda i: lpad(bin(strpos('0123456789abcdef', h[i + 1]) - 1), 4, '0')), 'string_agg', '') AS x FROM k)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_sum(list_transform(range(5), lambda j: CASE WHEN x[5 * i + j + 1] = '1' THEN 1 << (4 - j) ELSE 0 END))::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM bits
"""


@query("op6_warc", OP6_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder, ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@query("op5_embed_dedup")
def op5_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op9_ann")
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii.finder(docs, pii.fit(docs))(F.col("text")).alias("found"))
    base = found.withColumn("base", F.filter("found", lambda s: s["base"]))
    counts = [count_kind(F.col("base"), k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return base.select("doc_id", *counts, F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("found")).alias("spans"))


@query("op13_prefix_trie", sql.TRIE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(turns(table(spark, sf_dir, "conversations"))))


@query("op11_hard_negatives", sql.NEGATIVES)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query("op12_html_text")
def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
