"""Queries of the retrieval operators over embeddings, benchmark and documents. Every row whose id is divisible by 50 is a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .registry import registry, table

QUERIES, ORACLES, register = registry()

DENSE = """
    q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings WHERE vec_id % 50 = 0),
    dense_all AS (SELECT query_id, vec_id, round(list_cosine_similarity(e, CAST(embedding AS DOUBLE[])), 6) AS score FROM q JOIN embeddings ON vec_id <> query_id),
    dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense_all QUALIFY rank <= 8)
"""
LABEL = """
    second AS (
        SELECT query_id, vec_id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank
        FROM q JOIN embeddings x ON x.label = q.label AND vec_id <> query_id QUALIFY rank <= 8
    )
"""
FUSED = """
    fused0 AS (
        SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) AS fused, max(score) AS best_score
        FROM (SELECT query_id, vec_id, rank, score FROM dense UNION ALL SELECT query_id, vec_id, rank, score FROM second) GROUP BY ALL
    ),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vec_id) AS rank FROM fused0 QUALIFY rank <= 8)
"""


def _legs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    dense = R.dense_topk(q, e)
    # The second leg: items that share the query's label, in id order. The first of each label are all that can count, with one more for the query itself.
    firsts = R.top_per(e.select("vec_id", "label"), "label", [F.col("vec_id")], R.PREFETCH + 1, "_r").drop("_r")
    own = q.select("query_id", "label").join(firsts, "label").where("vec_id <> query_id").withColumn("score", F.lit(1.0))
    return e, dense, R.top_per(own, "query_id", [F.col("vec_id")], R.PREFETCH).select("query_id", "vec_id", "score", "rank")


@register(f"WITH {DENSE} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM dense")
def jn08_dense_topk(spark, sf_dir):
    """JN-08, SO-07, SC-61."""
    return _legs(spark, sf_dir)[1]


@register(f"WITH {DENSE}, {LABEL}, {FUSED} SELECT query_id, vec_id, fused, best_score, CAST(rank AS INTEGER) AS rank FROM fused")
def se01_rank_fusion(spark, sf_dir):
    """SE-01, WN-01."""
    _, dense, second = _legs(spark, sf_dir)
    return R.rrf([dense, second], "query_id", "vec_id")


@register(f"""WITH {DENSE}, {LABEL},
    part AS (
        SELECT query_id, vec_id, CASE WHEN stddev_pop(score) OVER w > 0 THEN (score - (avg(score) OVER w - 3 * stddev_pop(score) OVER w)) / (6 * stddev_pop(score) OVER w) ELSE 0.5 END AS part FROM dense WINDOW w AS (PARTITION BY query_id)
        UNION ALL SELECT query_id, vec_id, CASE WHEN stddev_pop(score) OVER w > 0 THEN (score - (avg(score) OVER w - 3 * stddev_pop(score) OVER w)) / (6 * stddev_pop(score) OVER w) ELSE 0.5 END FROM second WINDOW w AS (PARTITION BY query_id)
    ), f AS (SELECT query_id, vec_id, round(sum(part), 6) AS fused FROM part GROUP BY ALL)
    SELECT query_id, vec_id, fused, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, vec_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 8""")
def se02_distribution_fusion(spark, sf_dir):
    """SE-02."""
    _, dense, second = _legs(spark, sf_dir)
    return R.dbsf([dense, second], "query_id", "vec_id")


@register(f"""WITH {DENSE}, n AS (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS next FROM dense)
    SELECT query_id, vec_id, score AS top_score, round(score - coalesce(next, 0), 6) AS gap, score >= 0.5 AS above_threshold FROM n WHERE rank = 1""")
def flt11_answer_gate(spark, sf_dir):
    """FLT-11, WN-02."""
    return R.gate(_legs(spark, sf_dir)[1], "query_id", "vec_id", minimum=0.5)


@register(f"""WITH {DENSE}, f AS (SELECT d.*, x.label = q.label AS fits FROM dense d JOIN embeddings x USING (vec_id) JOIN q USING (query_id)),
    g AS (SELECT *, coalesce(NOT (max(CASE WHEN rank = 1 THEN fits END) OVER w), false) AND fits AND score >= greatest(0.02, 0.5 * max(score) OVER w) AS fine FROM f WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank, fits, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fine DESC, rank) AS INTEGER) AS new_rank FROM g""")
def so09_promote_fitting(spark, sf_dir):
    """SO-09: passages that fit go ahead if the first doesn't."""
    e, dense, _ = _legs(spark, sf_dir)
    labels = e.select("vec_id", "label")
    f = dense.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return R.promote(f.select("query_id", "vec_id", "score", "rank", (F.col("label") == F.col("wanted")).alias("fits")), "query_id", "rank", "score", "fits")


@register(f"""WITH {DENSE}, r AS (SELECT query_id, vec_id, rank, round(1.0 / (1 + abs(vec_id - query_id)), 6) AS rerank FROM dense)
    SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, rerank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, rank) AS INTEGER) AS final_rank FROM r QUALIFY final_rank <= 5""")
def so08_rerank_order(spark, sf_dir):
    """SO-08: by a scorer's value, then search rank; the scorer here is closeness of ids (a stand-in for a model's column)."""
    d = _legs(spark, sf_dir)[1].withColumn("rerank", F.round(1.0 / (1 + F.abs(F.col("vec_id") - F.col("query_id"))), 6))
    return R.top_per(d.select("query_id", "vec_id", "rank", "rerank"), "query_id", [F.desc("rerank"), F.col("rank")], R.RERANK, "final_rank")


TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"


@register(f"""WITH b AS (SELECT item_id, unnest({TOKENS.format('text')}) AS token FROM benchmark), bw AS (SELECT item_id, token, count(*)::DOUBLE AS wq FROM b GROUP BY ALL),
    d AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents), dw AS (SELECT doc_id, token, count(*)::DOUBLE AS wc FROM d GROUP BY ALL),
    s AS (SELECT item_id, doc_id, sum(wq * wc) AS score FROM bw JOIN dw USING (token) GROUP BY ALL)
    SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 8""")
def jn09_sparse_topk(spark, sf_dir):
    """JN-09."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    return R.sparse_topk(R.token_weights(b, "item_id"), d.select("doc_id", R.tokens(F.col("text")).alias("tokens")), "item_id", "doc_id")


@register("SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size, count(*) FILTER (WHERE embedding IS NULL) AS missing FROM embeddings")
def src09_dimension_guard(spark, sf_dir):
    """SRC-09."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(e) != 64).alias("wrong_size"), F.count_if(e.isNull()).alias("missing"))


@register("""WITH u AS (SELECT vec_id, label, 1 AS batch FROM embeddings UNION ALL SELECT vec_id, label + 100, 2 FROM embeddings WHERE label >= 5)
    SELECT vec_id, label, batch FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY batch DESC) AS r FROM u) WHERE r = 1""")
def src08_upsert(spark, sf_dir):
    """SRC-08: of all writes of an id the last batch counts."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    writes = e.withColumn("batch", F.lit(1)).unionByName(e.where("label >= 5").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("batch")))
    return R.keep_first(writes, [F.col("vec_id")], [F.desc("batch")])


@register("""WITH d AS (SELECT doc_id, source, lang, n_chars, sha256(text) AS h FROM documents), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1),
    b AS (SELECT *, max(n_chars) OVER (PARTITION BY source, lang) AS best FROM k)
    SELECT doc_id, source, lang, n_chars, CAST(n AS INTEGER) AS number, 'S' || n AS label FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY best DESC, lang, doc_id) AS n FROM b)""")
def wn16_sections(spark, sf_dir):
    """WN-15, WN-16: first of each text, then groups by their best member."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return R.sections(R.keep_first(d, [F.col("h")], [F.col("doc_id")]).drop("h"), ["lang"], "n_chars", "doc_id", "source")


@register(f"""WITH {DENSE}, p AS (SELECT query_id, max(score) AS m, list(vec_id ORDER BY rank) AS ids FROM dense GROUP BY 1)
    SELECT query_id, len(ids)::INTEGER AS n, list_aggregate(list_transform(ids, lambda x: x::VARCHAR), 'string_agg', ',') AS ids, m AS top FROM p""")
def flt22_payload(spark, sf_dir):
    """FLT-22: hits as one compact row for each query."""
    d = _legs(spark, sf_dir)[1].groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("x"), F.max("score").alias("top"))
    return d.select("query_id", F.size("x").alias("n"), F.array_join(F.transform("x", lambda v: v["vec_id"].cast("string")), ",").alias("ids"), "top")


@register("""SELECT b.item_id, d.doc_id, d.lang FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))""")
def jn10_evidence_containment(spark, sf_dir):
    """JN-10, FLT-09: documents whose text holds the evidence."""
    from ..operators.catalog import contained

    return contained(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
