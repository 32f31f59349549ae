"""Hybrid retrieval: dense and sparse legs, rank fusion, gate, ordering of what comes back (F3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered, shared_folder

RRF_K, PREFETCH, RERANK, MIN_SCORE = 60, 8, 5, 0.02
QUERY_BLOCK = 4096
#: Items that are scored at once against a block of queries.
SLICE = 1024
#: Scores that a task of a dense search holds at once.
CELLS = 1 << 20


def top_per(df: DataFrame, key: str | list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """WN-01, SO-07: rank rows within a key and keep the first k; Spark limits each group before its shuffle."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def unit(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """Rows scaled to unit length, short ones padded with zeros; zero vectors stay zero (SC-61), one that isn't finite is NaN throughout."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    flat, v = np.asarray(column.flatten()).astype(np.float64), np.zeros((len(column), max(width, int(sizes.max(initial=0)))))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    v[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    scaled = np.divide(v, norm, out=np.zeros_like(v), where=(norm > 0) & np.isfinite(norm))
    scaled[~np.isfinite(norm[:, 0])] = np.nan
    return scaled


def first_k(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id; sorts only what reaches the kth score."""
    if len(scores) > k:
        rows = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]
    return np.lexsort((ids, -scores))


def merged(score: np.ndarray, item: np.ndarray, found: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of score (with items) and of found (columns: items own, ascending), best first, ties to the smaller item; -inf is none."""
    better = np.flatnonzero((found.max(axis=1, initial=-np.inf) >= score[:, -1]) & (found > -np.inf).any(axis=1))
    if not len(better):
        return score, item
    f = found[better]
    if f.shape[1] > k:
        # Of the scores that tie with the kth, those of the first columns count.
        kth = np.partition(f, f.shape[1] - k, axis=1)[:, f.shape[1] - k, None]
        over, tied = f > kth, f == kth
        keep = over | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - over.sum(axis=1)[:, None]))
        at = np.nonzero(keep)[1].reshape(len(f), k)
        f, items = np.take_along_axis(f, at, axis=1), own[at]
    else:
        items = np.broadcast_to(own, f.shape)
    s, i = np.concatenate([score[better], f], axis=1), np.concatenate([item[better], items], axis=1)
    best = np.lexsort((i, -s), axis=1)[:, :k]
    score[better], item[better] = np.take_along_axis(s, best, axis=1), np.take_along_axis(i, best, axis=1)
    return score, item


def block_by_block(queries: DataFrame, corpus: DataFrame, key: str, block_of, search, schema: str, finish, block: int = QUERY_BLOCK) -> DataFrame:
    """search(broadcast of block_of(table)) over corpus for every block of queries, then finish(found).

    One block is broadcast as it is. More go one after the other: the queries are written by block, each block's result is written, and
    its broadcast released, so the driver never holds more than one.
    """
    spark = corpus.sparkSession
    n = -(-queries.select(key).distinct().count() // block)
    if n <= 1:
        shared = spark.sparkContext.broadcast(block_of(queries.toArrow()))
        return finish(corpus.mapInArrow(search(shared), schema))
    path, found = shared_folder(spark, "query-blocks"), shared_folder(spark, "query-results")
    queries.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n))).repartition("_block").write.partitionBy("_block").parquet(path)
    result = None
    for b in range(n):
        own = spark.read.parquet(path).where(F.col("_block") == b).drop("_block").toArrow()
        shared = spark.sparkContext.broadcast(block_of(own))
        part = finish(corpus.mapInArrow(search(shared), schema))
        result = part.schema
        part.write.parquet(f"{found}/block={b}")
        shared.destroy()
    return spark.read.schema(result).parquet(*[f"{found}/block={b}" for b in range(n)])


def best_items(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k items (id, vector) nearest to each unit vector of q, other than its own id, best first; at most CELLS scores are held at once. A score of NaN goes first, as in Spark's order, and is returned as infinite."""
    step = max(1, min(SLICE, CELLS // max(len(ids), 1)))
    score, item = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
    for batch in batches:
        items = np.asarray(batch.column(0))
        for first in range(0, len(items), step):
            own, v = items[first : first + step], unit(batch.column(1).slice(first, step), q.shape[1])
            order = np.argsort(own, kind="stable")
            own, v = own[order], v[order]
            found = np.round(q @ v[:, : q.shape[1]].T, digits)
            found[np.isnan(found)] = np.inf
            found[ids[:, None] == own] = -np.inf
            score, item = merged(score, item, found, own, k)
    return score, item


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int = PREFETCH, query_id: str = "query_id", item_id: str = "vec_id", vector: str = "embedding", digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """JN-08, SO-07: for each query its k nearest items by cosine (rounded), ties to the smaller id, the query itself left out.

    Queries go out in blocks of bounded size; each task multiplies a block with a few rows at a time, at most CELLS scores, holds the k best of each query and passes on k rows a query. Null vectors and
    those that hold nulls take no part; shorter ones count as padded with zeros; NaN, the score of one that isn't finite, is above all others.
    """
    usable = lambda df, i: df.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull())).select(i, vector)

    def block_of(table: pa.Table):
        return np.asarray(table.column(0).combine_chunks()), unit(pa.concat_arrays(table.column(1).chunks)) if table.num_rows else np.zeros((0, 0))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            score, item = best_items(batches, ids, q, k, digits)
            held = score > -np.inf
            score[score == np.inf] = np.nan
            yield pa.record_batch([pa.array(np.repeat(ids, held.sum(axis=1)).astype(np.int64)), pa.array(item[held]), pa.array(score[held])], names=[query_id, item_id, "score"])

        return run

    finish = lambda found: top_per(found, query_id, [F.desc("score"), F.col(item_id)], k)
    return block_by_block(usable(queries, query_id), usable(corpus, item_id), query_id, block_of, search, f"{query_id} long, {item_id} long, score double", finish, block)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def token_weights(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, token, weight: how often each token occurs."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def sparse_topk(queries: DataFrame, corpus: DataFrame, query_id: str, item_id: str, k: int = PREFETCH, digits: int | None = None, share: bool = False, block: int = 512) -> DataFrame:
    """JN-09: for each query its k best items by the sum of weight products over the tokens that they share (weights above zero), ties to the smaller id.

    queries: (id, token, weight). corpus: (id, tokens), an array with repeats, whose counts are the weights. A block of queries goes out as an
    inverted index; a task scores a few items against it at a time and passes on k rows a query, so a word that all hold makes no pair that is shuffled.
    share: the score is the share of the query's total weight whose tokens the item has.
    """

    def block_of(table: pa.Table):
        ids, tokens_, weights = (np.asarray(table.column(c).combine_chunks().to_numpy(zero_copy_only=False)) for c in (query_id, "token", "weight"))
        keys, place = np.unique(ids, return_inverse=True)
        words, number = np.unique(tokens_.astype(str), return_inverse=True)
        order = np.argsort(number, kind="stable")
        starts = np.searchsorted(number[order], np.arange(len(words) + 1))
        return keys, {w: i for i, w in enumerate(words.tolist())}, starts, place[order], weights[order].astype(np.float64), np.bincount(place, weights, len(keys))

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, words, starts, place, weights, totals = shared.value
            best_score, best_item = np.full((len(keys), k), -1.0), np.zeros((len(keys), k), np.int64)
            for batch in batches:
                lists = batch.column(1)
                coded = lists.flatten().dictionary_encode()
                number = np.array([words.get(w, -1) for w in coded.dictionary.to_pylist()] or [-1], np.int64)[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
                known = number >= 0
                pair, count = np.unique(row[known] * (len(words) + 1) + number[known], return_counts=True)
                row, number = np.divmod(pair, len(words) + 1)
                items = np.asarray(batch.column(0))
                for first in range(0, len(items), SLICE):
                    a, b = np.searchsorted(row, [first, first + SLICE])
                    hits = starts[number[a:b] + 1] - starts[number[a:b]]
                    at = np.repeat(starts[number[a:b]] - (np.cumsum(hits) - hits), hits) + np.arange(int(hits.sum()))
                    cell = place[at] * SLICE + np.repeat(row[a:b] - first, hits)
                    value = weights[at] * (1 if share else np.repeat(count[a:b], hits))
                    score = np.bincount(cell, value, len(keys) * SLICE).reshape(len(keys), SLICE)[:, : len(items) - first]
                    score = score / np.maximum(totals, 1e-300)[:, None] if share else score
                    score = score if digits is None else np.round(score, digits)
                    own = items[first : first + SLICE]
                    for q in np.flatnonzero((score > 0).any(axis=1) & (score.max(axis=1, initial=0) >= best_score.min(axis=1))):
                        rows = np.flatnonzero(score[q] > 0)
                        s, i = np.concatenate([best_score[q], score[q, rows]]), np.concatenate([best_item[q], own[rows]])
                        best = first_k(s, i, k)
                        best_score[q], best_item[q] = s[best], i[best]
            found = best_score > 0
            yield pa.record_batch([pa.array(np.repeat(keys, found.sum(axis=1)).astype(np.int64)), pa.array(best_item[found]), pa.array(best_score[found])], names=[query_id, item_id, "score"])

        return run

    finish = lambda found: top_per(found, query_id, [F.desc("score"), F.col(item_id)], k)
    return block_by_block(queries.select(query_id, "token", "weight"), corpus.select(item_id, "tokens"), query_id, block_of, search, f"{query_id} long, {item_id} long, score double", finish, block)


def rrf(legs: list[DataFrame], query_id: str, item_id: str, k: int = RRF_K, limit: int = PREFETCH) -> DataFrame:
    """SE-01: reciprocal-rank fusion of ranked lists (query, item, rank, score); keeps the best score, ties to the smaller id."""
    both = legs[0].select(query_id, item_id, "rank", "score")
    for leg in legs[1:]:
        both = both.unionByName(leg.select(query_id, item_id, "rank", "score"))
    fused = both.groupBy(query_id, item_id).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("fused"), F.max("score").alias("best_score"))
    return top_per(fused, query_id, [F.desc("fused"), F.col(item_id)], limit)


def dbsf(legs: list[DataFrame], query_id: str, item_id: str, limit: int = PREFETCH) -> DataFrame:
    """SE-02: distribution-based fusion, (s - (m - 3 sd)) / 6 sd within each leg and query, then summed; equal scores count a half."""
    parts = []
    for leg in legs:
        w = Window.partitionBy(query_id)
        sd = F.stddev_pop("score").over(w)
        parts.append(leg.select(query_id, item_id, F.when(sd > 0, (F.col("score") - (F.avg("score").over(w) - 3 * sd)) / (6 * sd)).otherwise(0.5).alias("part")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy(query_id, item_id).agg(F.round(F.sum("part"), 6).alias("fused"))
    return top_per(fused, query_id, [F.desc("fused"), F.col(item_id)], limit)


def gate(hits: DataFrame, query_id: str, item_id: str, score: str = "score", minimum: float = MIN_SCORE, vetoes: Column | None = None) -> DataFrame:
    """WN-02, FLT-11: top score, its lead over the runner-up (itself if alone), and whether it passes with nothing missing."""
    w = Window.partitionBy(query_id).orderBy(F.desc(score), F.col(item_id))
    ranked = hits.withColumn("_next", F.lead(score).over(w)).withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    ok = F.col(score) >= minimum
    return ranked.select(query_id, item_id, F.col(score).alias("top_score"), F.round(F.col(score) - F.coalesce("_next", F.lit(0.0)), 6).alias("gap"), (ok if vetoes is None else ok & ~vetoes).alias("above_threshold"))


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """WN-15: the first row of each key."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    return top_per(keyed, names, order, 1, "_rank").drop("_rank", *names)


def sections(df: DataFrame, group: list[str], score: str, position: str, scope: str) -> DataFrame:
    """WN-16: groups within a scope ordered by their best member, members in reading order, numbered S1, S2, …"""
    best = df.groupBy(*[F.col(c).alias(f"_of_{c}") for c in (scope, *group)]).agg(F.max(score).alias("_best"))
    same = F.lit(True)
    for c in (scope, *group):
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    ordered = numbered(df.join(best, same).select(*df.columns, "_best"), [scope], [F.desc("_best"), *[F.col(g) for g in group], F.col(position)], "number")
    return ordered.withColumn("label", F.concat(F.lit("S"), F.col("number").cast("string"))).drop("_best")


def promote(df: DataFrame, key: str, rank: str, score: str, fits: str, minimum: float = MIN_SCORE) -> DataFrame:
    """SO-09: if the first row doesn't fit, rows that do and reach half the best score (and the minimum) go first; otherwise the order stays."""
    w = Window.partitionBy(key)
    first_fits = F.max(F.when(F.col(rank) == 1, F.col(fits))).over(w)
    fine = ~first_fits & F.col(fits) & (F.col(score) >= F.greatest(F.lit(minimum), 0.5 * F.max(score).over(w)))
    return df.withColumn("_fine", fine).withColumn("new_rank", F.row_number().over(w.orderBy(F.desc("_fine"), F.col(rank)))).drop("_fine")


def over_grid(hits: DataFrame, grid: list[tuple[int, float]], fits: Column) -> DataFrame:
    """UD-10, UD-06: k, minimum, hit (queries with a fitting hit among the first k from minimum on), returned: every point of a grid in one pass."""
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(m)).alias("minimum")) for k, m in grid])
    each = hits.withColumn("fits", fits).withColumn("p", F.explode(points)).select("query_id", "fits", "p.k", "p.minimum", ((F.col("rank") <= F.col("p.k")) & (F.col("score") >= F.col("p.minimum"))).alias("in"))
    by_query = each.groupBy("k", "minimum", "query_id").agg(F.max((F.col("in") & F.col("fits")).cast("int")).alias("hit"), F.count_if("in").alias("returned"))
    return by_query.groupBy("k", "minimum").agg(F.sum("hit").alias("hit"), F.sum("returned").alias("returned"))
