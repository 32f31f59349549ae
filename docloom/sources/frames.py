"""The catalog's frames, derived from the given tables: chats and messages from conversations, documents with hashes and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, project_id, filename, sha256, status, version, n_chars, lang: a source is a project; the status follows the id."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    status = F.when(F.col("doc_id") % 7 == 3, "PENDING").when(F.col("doc_id") % 11 == 5, "FAILED").otherwise("READY")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("project_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), status.alias("status"), (1 + F.col("doc_id") % 3).cast("int").alias("version"), "n_chars", "lang")


DOCUMENTS_SQL = """docs AS (SELECT doc_id AS id, source AS project_id, 'doc_' || doc_id || '.txt' AS filename, sha256(text) AS sha256,
    CASE WHEN doc_id % 7 = 3 THEN 'PENDING' WHEN doc_id % 11 = 5 THEN 'FAILED' ELSE 'READY' END AS status, CAST(1 + doc_id % 3 AS INTEGER) AS version, n_chars, lang FROM documents)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_id, seq (from 1, gap-free), role (agent for assistant, event for system), text."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    role = F.when(F.col("role") == "assistant", "agent").when(F.col("role") == "system", "event").otherwise(F.col("role"))
    return c.select(F.col("conv_id").alias("chat_id"), (F.col("turn") + 1).alias("seq"), role.alias("role"), "text")


MESSAGES_SQL = "msgs AS (SELECT conv_id AS chat_id, turn + 1 AS seq, CASE role WHEN 'assistant' THEN 'agent' WHEN 'system' THEN 'event' ELSE role END AS role, text FROM conversations)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, state: a job for each labelled document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select(F.col("doc_id").alias("document_id"), F.when(F.col("toxic") == 1, "RUNNING").when(F.col("quality") == 0, "QUEUED").otherwise("SUCCEEDED").alias("state"))


JOBS_SQL = "jobs AS (SELECT doc_id AS document_id, CASE WHEN toxic = 1 THEN 'RUNNING' WHEN quality = 0 THEN 'QUEUED' ELSE 'SUCCEEDED' END AS state FROM labels)"
