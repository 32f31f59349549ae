"""Evaluation analytics: recall, rank metrics, confusion, sweeps, percentiles, histograms (F6). Pure aggregation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of a sweep.
SWEEP = [0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b, null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), digits)


def question_ranks(hits: DataFrame, question: str | list[str], rank: str, hit: str, found: str, k: int) -> DataFrame:
    """AG-07: per question the first hit's rank, how many distinct targets are covered within k, and success."""
    near = (F.col(rank) <= k) & F.col(hit)
    return hits.groupBy(question).agg(
        F.min(F.when(F.col(hit), F.col(rank))).alias("first_rank"), F.count_distinct(F.when(near, F.col(found))).alias("covered"), F.coalesce(F.bool_or(near), F.lit(False)).alias("success")
    )


def macro(per_question: DataFrame, by: list[str], targets: str = "targets") -> DataFrame:
    """AG-08: recall, success and mean reciprocal rank averaged over questions."""
    return per_question.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("covered") / F.col(targets)), 6).alias("recall"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def confusion(df: DataFrame, by: list[str], score: Column, truth: Column, threshold: Column) -> DataFrame:
    """AG-15: counts at a threshold and the rates they give; a rate with nothing below is null."""
    said = score >= threshold
    c = df.groupBy(*by).agg(F.count_if(said & truth).alias("tp"), F.count_if(said & ~truth).alias("fp"), F.count_if(~said & truth).alias("fn"), F.count_if(~said & ~truth).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("false_rate"), ratio(fn, tp + fn).alias("miss_rate"))


def sweep(df: DataFrame, score: str, truth: str, thresholds: list[float] = SWEEP) -> DataFrame:
    """AG-17, JN-15: the confusion counts at every threshold in one pass; the thresholds are a literal array."""
    rows = df.select(F.col(score).alias("s"), F.col(truth).alias("t"), F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    return confusion(rows, ["threshold"], F.col("s"), F.col("t"), F.col("threshold"))


def candidate_thresholds(df: DataFrame, score: str, digits: int = 5) -> DataFrame:
    """AG-19: distinct scores floored to so many decimals."""
    return df.select((F.floor(F.col(score) * 10**digits) / 10**digits).alias("threshold")).distinct()


def score_counts(df: DataFrame, score: str, truth: str, digits: int = 5) -> DataFrame:
    """Positives and negatives at each floored score: at most 10^digits rows a unit, however many samples."""
    s = (F.floor(F.col(score) * 10**digits) / 10**digits).alias("s")
    return df.select(s, F.col(truth).alias("t")).groupBy("s").agg(F.count_if("t").alias("pos"), F.count_if(~F.col("t")).alias("neg"))


def auc(df: DataFrame, score: str, truth: str, digits: int = 5) -> DataFrame:
    """AG-18, JN-14: share of positive-negative pairs in the right order, ties a half, from ranks over floored scores instead of a cross join."""
    counts = score_counts(df, score, truth, digits)
    below = F.coalesce(F.sum("neg").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = counts.select("pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("won"))
    return won.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), ratio(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))


def best_thresholds(swept: DataFrame, min_recall: float) -> DataFrame:
    """AG-20: the threshold of most F1 (ties to the higher), and the highest that keeps recall."""
    return swept.agg(F.max_by("threshold", F.struct(F.coalesce("f1", F.lit(-1.0)), F.col("threshold"))).alias("best_f1_at"), F.round(F.max("f1"), 6).alias("best_f1"), F.max(F.when(F.col("recall") >= min_recall, F.col("threshold"))).alias("recall_at"))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG-11, AG-12, AG-14: count, extremes, mean and interpolated percentiles."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)]))
    d = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), p.alias("_p"))
    return d.select(*by, "n", "least", "most", "mean", *[F.round(F.col("_p")[i], 6).alias(x) for i, x in enumerate(("p10", "p25", "p50", "p75", "p90", "p95"))])


def histogram(df: DataFrame, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """AG-13: half-open buckets between edges, ends clamped, empty buckets kept."""
    inner = [float(x) for x in edges[1:-1]]
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in inner]), lambda e: F.col("_v") >= e))
    counted = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value)).groupBy(*by, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))).alias("bucket"))
    e = F.array(*[F.lit(float(x)) for x in edges])
    return grid.join(counted, [*by, "bucket"], "left").select(*by, "bucket", e[F.col("bucket")].alias("from_edge"), e[F.col("bucket") + 1].alias("to_edge"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def summary(df: DataFrame, dims: list[str], measures: list[Column]) -> DataFrame:
    """AG-21, AG-22: overall and by each dimension alone, in one pass of grouping sets."""
    level = F.grouping_id().alias("level")
    sets = [[], *[[F.col(d)] for d in dims]]
    return df.groupingSets(sets, *[F.col(d) for d in dims]).agg(level, *measures)


def _wer(reference: str | None, heard: str | None) -> float | None:
    ref, hyp = (reference or "").split(), np.array((heard or "").split(), dtype=object)
    if not ref:
        return None
    steps = np.arange(len(hyp) + 1)
    prev = steps.copy()
    for i, w in enumerate(ref, 1):
        row = np.concatenate([[i], np.minimum(prev[1:] + 1, prev[:-1] + (hyp != w))])
        prev = np.minimum.accumulate(row - steps) + steps
    return round(int(prev[-1]) / len(ref), 6)


def word_error_rate(reference: Column, heard: Column) -> Column:
    """SC-26: word-level edit distance over the reference's words; null without reference words. Arrow batches, since the table of distances has no Spark function."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([_wer(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(reference, heard)
