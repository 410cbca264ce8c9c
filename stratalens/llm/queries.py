"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, hmm_lm, html_text, langid, mixing, near_dup, secrets, warc
from .common import crc_remainder, few_files, table


def tokenizer_path() -> str:
    """The vocabulary file of the encoding query; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max").drop("row_id"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = warc.round_trip(pages)
    answer = F.col("warc_type") == "response"
    return few_files(found).select(
        F.element_at("metadata.fields", "source-id").cast("long").alias("page_id"),
        F.when(answer, F.octet_length("payload")).otherwise(F.col("http_length")).cast("long").alias("payload_bytes"),
        F.when(answer, warc.base32_sha1(F.col("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(~answer, F.col("original.source_id")).alias("refers_to"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(mixing.taken(mixing.mix(table(spark, sf_dir, "documents"))))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(hmm_lm.score(table(spark, sf_dir, "documents")))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("row_id"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = few_files(secrets.scan(table(spark, sf_dir, "documents")))
    count = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(secrets.BASE)]
    return found.select("doc_id", *count, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return few_files(ann.nearest(table(spark, sf_dir, "embeddings")))


OP2_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP5_SQL = """
WITH d AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), h AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS first FROM d
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_html_text": op4_html_text,
    "op5_warc": op5_warc,
    "op6_mixing": op6_mixing,
    "op7_lm_score": op7_lm_score,
    "op8_near_dup": op8_near_dup,
    "op9_secrets": op9_secrets,
    "op10_nearest": op10_nearest,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op5_warc": OP5_SQL,
}
