"""From raw documents to packed sequences: quality rules, language identification, near-duplicate removal, redaction, packing.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. run() writes each result as Parquet in the shared folder and reads it back as the next one's docs.

Rows without a doc_id take part in the near-duplicate stage: a class of such rows keeps that with the smallest text hash, any other class
none of them. Rows that share a doc_id count as one document there: that with the smallest text hash. A null text has no words, so the rules reject it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import langid, nearcopies, packing, pii, rules
from docloom.llm.common import held_out_sql, materialize

#: A document whose language's filters hold less than this share of its n-grams is rejected.
LEAST_SHARE = 0.3
MARK = "_docloom"
#: Rows of an Arrow batch on the way to Python and back: documents are long, so Spark's default of 10,000 holds much memory at once.
BATCH_ROWS = 500
#: Chunks that a packing task remembers and remainders that it holds: fewer than by default, since executors have stages behind them whose memory they keep.
MEMO_WORDS, WAITING = 60_000, 4_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules reject. Trusted: documents labelled as of good quality, less those held out."""
    small_batches(spark)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where(f"quality = 1 AND NOT {held_out_sql()}").select("doc_id")
    model = rules.ratios(docs, trusted)
    return docs.withColumn(MARK, rules.verdict(docs, model)).where(F.col(f"{MARK}.kept")).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language and sets lang to the predicted one."""
    small_batches(spark)
    filters = langid.fit(docs.where(f"NOT coalesce({held_out_sql()}, false)"))
    found = docs.withColumn(MARK, langid.language(docs, filters))
    kept = found.where((F.col(f"{MARK}.lang") != langid.UNDETERMINED) & (F.col(f"{MARK}.share") >= LEAST_SHARE))
    return kept.withColumn("lang", F.col(f"{MARK}.lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each class; texts of 0.8-similar five-word shingles are in one class."""
    small_batches(spark)
    th, cols = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), docs.columns
    one = lambda rows, *by: rows.groupBy(*by).agg(F.first(F.struct(*cols)).alias("x")).select("x.*")
    firsts = docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(MARK)).agg(F.count(F.lit(1)).alias("n"), F.min(th).alias(f"{MARK}_th"))
    firsts = materialize(firsts.where("n > 1").drop("n"), "pipeline-ids")
    if not firsts.isEmpty():
        again = F.col("doc_id") == F.col(MARK)
        docs = materialize(docs.join(firsts, again, "left_anti").unionByName(one(docs.join(firsts, again & (th == F.col(f"{MARK}_th")), "left_semi"), "doc_id")), "pipeline-single")
    classes = materialize(nearcopies.near_duplicates(docs), "pipeline-classes")
    others = materialize(classes.where("doc_id <> component_id").select(F.col("doc_id").alias(MARK)), "pipeline-copies")
    kept = docs.where("doc_id IS NOT NULL").join(others, F.col("doc_id") == F.col(MARK), "left_anti")
    if docs.where("doc_id IS NULL").isEmpty():
        return kept
    lone = classes.where("component_id IS NULL").groupBy("class").agg(F.min("th").alias(MARK)).select(MARK)
    nulls = docs.where("doc_id IS NULL").withColumn(f"{MARK}_th", th).join(lone, F.col(f"{MARK}_th") == F.col(MARK), "left_semi")
    return kept.unionByName(one(nulls, f"{MARK}_th"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each piece of personal data."""
    found = pii.with_spans(docs, pii.fit(docs), name=MARK)
    spans = F.concat(f"{MARK}.base", f"{MARK}.added")
    changed = found.withColumn("text", pii.redacted(F.col("text"), spans))
    return changed.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed-size sequences, see docloom.llm.packing."""
    small_batches(spark)
    return packing.pack(docs, packing.word_tokenizer(), waiting=WAITING, memo_words=MEMO_WORDS)


STAGES = [("quality rules", quality_rules), ("language ID", language), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", packed)]

#: SQL can express neither the likelihood ratio's byte n-grams nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
