"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_speculative, chat_format, cotraining, exact_dedup, maxent_lm, packing, quality_rules, sharding, simhash, warc_store
from .common import shared_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "text_score", "meta_score", "score", "kept")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    same = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(more)
    return chat_format.digest(chat_format.format_conversations(turns, BYTE_BPE))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=False)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc_store.write_archive(table(spark, sf_dir, "pages"), path)
    return warc_store.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("region", "rack")


def op9_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_speculative.encode_documents(table(spark, sf_dir, "documents"), BYTE_BPE, digests=True)


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(32 + length(role) + length(escaped)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, {'a': -n, 'b': doc_id}) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
q AS (
  SELECT *, max(page_id) OVER (PARTITION BY x, payload_bytes) AS best,
         list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS five FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(five, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> b) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM q
"""


def queries() -> dict:
    return {
        "op1_quality_cotraining": op1_quality_cotraining,
        "op2_chat_format": op2_chat_format,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_warc": op4_warc,
        "op5_quality_rules": op5_quality_rules,
        "op6_simhash": op6_simhash,
        "op7_packing": op7_packing,
        "op8_sharding": op8_sharding,
        "op9_maxent_lm": op9_maxent_lm,
        "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op4_warc": OP4_SQL}
