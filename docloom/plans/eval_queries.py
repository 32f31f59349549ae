"""Queries of the evaluation metrics: labels as truth, a length-derived score, nearest neighbours as passages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evalmetrics as E
from ..operators import retrieval as R
from .registry import registry, table
from .retrieval_queries import DENSE

QUERIES, ORACLES, register = registry()

SCORED = "s AS (SELECT l.doc_id, d.lang, d.source, least(1.0, round(d.n_chars / 5000.0, 4)) AS score, l.quality = 1 AS truth FROM labels l JOIN documents d USING (doc_id))"


def scored(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return labels.join(d, "doc_id").select("doc_id", "lang", "source", F.least(F.lit(1.0), F.round(F.col("n_chars") / 5000.0, 4)).alias("score"), (F.col("quality") == 1).alias("truth"))


RATES = """tp, fp, fn, tn, round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 6) AS f1,
    round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS false_rate, round(fn / nullif(tp + fn, 0)::DOUBLE, 6) AS miss_rate"""
COUNTS = "count(*) FILTER (WHERE score >= {0} AND truth) AS tp, count(*) FILTER (WHERE score >= {0} AND NOT truth) AS fp, count(*) FILTER (WHERE score < {0} AND truth) AS fn, count(*) FILTER (WHERE score < {0} AND NOT truth) AS tn"
SWEPT = f"t AS (SELECT unnest({E.SWEEP}::DOUBLE[]) AS threshold), w0 AS (SELECT threshold, {COUNTS.format('threshold')} FROM s, t GROUP BY 1), w AS (SELECT threshold, {RATES} FROM w0)"


@register(f"WITH {SCORED}, c AS (SELECT lang, {COUNTS.format(0.3)} FROM s GROUP BY 1) SELECT lang, {RATES} FROM c")
def ag15_confusion(spark, sf_dir):
    """AG-15."""
    return E.confusion(scored(spark, sf_dir), ["lang"], F.col("score"), F.col("truth"), F.lit(0.3))


@register(f"WITH {SCORED}, {SWEPT} SELECT * FROM w")
def ag17_sweep(spark, sf_dir):
    """AG-17, JN-15."""
    return E.sweep(scored(spark, sf_dir), "score", "truth")


@register(f"WITH {SCORED}, {SWEPT} SELECT arg_max(threshold, {{'f': coalesce(f1, -1), 't': threshold}}) AS best_f1_at, round(max(f1), 6) AS best_f1, max(threshold) FILTER (WHERE recall >= 0.8) AS recall_at FROM w")
def ag20_best_thresholds(spark, sf_dir):
    """AG-20."""
    return E.best_thresholds(E.sweep(scored(spark, sf_dir), "score", "truth"), 0.8)


@register(f"WITH {SCORED} SELECT DISTINCT floor(score * 100000) / 100000 AS threshold FROM s")
def ag19_candidate_thresholds(spark, sf_dir):
    """AG-19."""
    return E.candidate_thresholds(scored(spark, sf_dir), "score")


@register(f"""WITH {SCORED}, p AS (SELECT score FROM s WHERE truth), n AS (SELECT score FROM s WHERE NOT truth)
    SELECT (SELECT count(*) FROM p) AS positives, (SELECT count(*) FROM n) AS negatives, round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc FROM p, n""")
def ag18_auc(spark, sf_dir):
    """AG-18, JN-14."""
    return E.auc(scored(spark, sf_dir), "score", "truth")


HITS = f"{DENSE}, h AS (SELECT d.query_id, d.rank, d.vec_id, x.label = q.label AS hit, q.label FROM dense d JOIN embeddings x USING (vec_id) JOIN q USING (query_id))"
PER = "p AS (SELECT query_id, label, min(rank) FILTER (WHERE hit) AS first_rank, count(DISTINCT vec_id) FILTER (WHERE hit AND rank <= 5) AS covered, coalesce(bool_or(hit AND rank <= 5), false) AS success FROM h GROUP BY ALL)"


def hits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    dense = R.dense_topk(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e)
    labels = e.select("vec_id", "label")
    wanted = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted"))
    return dense.join(labels, "vec_id").join(wanted, "query_id").withColumn("hit", F.col("label") == F.col("wanted"))


@register(f"WITH {HITS}, {PER} SELECT query_id, CAST(first_rank AS INTEGER) AS first_rank, covered, success FROM p")
def ag07_question_ranks(spark, sf_dir):
    """AG-07: neighbours as passages, those with the query's label as targets."""
    return E.question_ranks(hits(spark, sf_dir), ["query_id", "wanted"], "rank", "hit", "vec_id", 5).drop("wanted")


@register(f"WITH {HITS}, {PER} SELECT label, count(*) AS questions, round(avg(covered / 5.0), 6) AS recall, round(avg(success::INT), 6) AS success_rate, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM p GROUP BY 1")
def ag08_recall_mrr(spark, sf_dir):
    """AG-08."""
    per = E.question_ranks(hits(spark, sf_dir), ["query_id", "wanted"], "rank", "hit", "vec_id", 5)
    return E.macro(per.withColumn("targets", F.lit(5)).withColumnRenamed("wanted", "label"), ["label"])


@register(f"WITH {HITS}, o AS (SELECT label, bool_or(hit AND rank = 1) AS first, avg(hit::INT) AS share FROM h GROUP BY label, query_id) SELECT label, round(avg(first::INT), 6) AS top1, round(avg(share), 6) AS precision FROM o GROUP BY 1")
def ag10_citation_precision(spark, sf_dir):
    """AG-09, AG-10: accuracy of the first passage, share of passages that hit."""
    per = hits(spark, sf_dir).groupBy("wanted", "query_id").agg(F.bool_or(F.col("hit") & (F.col("rank") == 1)).cast("double").alias("first"), F.avg(F.col("hit").cast("double")).alias("share"))
    return per.groupBy(F.col("wanted").alias("label")).agg(F.round(F.avg("first"), 6).alias("top1"), F.round(F.avg("share"), 6).alias("precision"))


PERCENTILES = ", ".join(f"round(quantile_cont({{0}}, {p}), 6) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95))


@register(f"SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, {PERCENTILES.format('value')} FROM events GROUP BY 1")
def ag12_describe(spark, sf_dir):
    """AG-11, AG-12, AG-14."""
    return E.describe(table(spark, sf_dir, "events"), ["event_type"], "value")


@register(f"SELECT lang, count(t) AS n, min(t) AS least, max(t) AS most, round(avg(t), 6) AS mean, {PERCENTILES.format('t')} FROM (SELECT lang, CAST(ceil(length(text) / 3.5) AS BIGINT) AS t FROM documents) GROUP BY 1")
def ag23_token_stats(spark, sf_dir):
    """AG-23, SC-09."""
    d = table(spark, sf_dir, "documents").select("lang", F.ceil(F.length("text") / 3.5).cast("long").alias("t"))
    return E.describe(d, ["lang"], "t")


@register("""WITH b AS (SELECT event_type, CASE WHEN value >= 100 THEN 4 WHEN value >= 60 THEN 3 WHEN value >= 30 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END AS bucket FROM events WHERE value IS NOT NULL),
    g AS (SELECT event_type, unnest(range(5)) AS bucket FROM (SELECT DISTINCT event_type FROM events))
    SELECT g.event_type, CAST(g.bucket AS INTEGER) AS bucket, CAST([0, 10, 30, 60, 100][g.bucket + 1] AS DOUBLE) AS from_edge, CAST([10, 30, 60, 100, 1000][g.bucket + 1] AS DOUBLE) AS to_edge, count(b.bucket) AS n
    FROM g LEFT JOIN b ON g.event_type = b.event_type AND g.bucket = b.bucket GROUP BY ALL""")
def ag13_histogram(spark, sf_dir):
    """AG-13."""
    return E.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", [0, 10, 30, 60, 100, 1000])


@register(f"""WITH {SCORED} SELECT lang, source, grouping_id(lang, source) AS level, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE truth) AS good FROM s GROUP BY GROUPING SETS ((), (lang), (source))""")
def ag21_summary(spark, sf_dir):
    """AG-21, AG-22."""
    return E.summary(scored(spark, sf_dir), ["lang", "source"], [F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if("truth").alias("good")])


@register(f"WITH {SCORED} SELECT lang, count(*) FILTER (WHERE score >= 0.3 AND NOT truth) AS wrongly_kept, count(*) AS n FROM s GROUP BY 1 ")
def ag16_wrong_by_kind(spark, sf_dir):
    """AG-16."""
    return scored(spark, sf_dir).groupBy("lang").agg(F.count_if((F.col("score") >= 0.3) & ~F.col("truth")).alias("wrongly_kept"), F.count(F.lit(1)).alias("n"))


@register("SELECT event_type, user_id % 3 AS mode, round(avg((value > 50)::INT), 6) AS rate, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def ag34_outcome_rates(spark, sf_dir):
    """AG-34."""
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 3).alias("mode")).agg(F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("rate"), F.round(F.avg("value"), 6).alias("mean_value"))


@register()
def sc26_word_error_rate(spark, sf_dir):
    """SC-26: each turn against the turn before it in the conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("before IS NOT NULL").select("conv_id", "turn", E.word_error_rate(F.col("before"), F.col("text")).alias("wer"))
