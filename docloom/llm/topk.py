"""Exact top-k by inner product with Fagin's threshold algorithm.

A task reads its candidates in blocks of bounded size. A block keeps, for every dimension, its rows sorted by that component. For a
query the lists are read in step from their favourable end (descending where the query's component is positive, ascending where
it is negative); every row met is scored in full; the sum of query component times list value at the current depth bounds all
rows not met yet, and reading stops once the kth score found so far, over all blocks of the task, is above that bound. A bound
equal to the kth score does not stop it, since a tie may have a smaller id. Each task gives k rows a query; a ranked window
merges them.

Queries go to the tasks in blocks of about QUERY_BLOCK, one after the other: a block is read from its own folder of a written table, broadcast,
searched in one pass over the candidates, its result written to the shared folder, and the broadcast released. The driver holds one block.

Defined cases: vectors that are null, that hold null or non-finite components, or whose scaled components aren't finite take no part; a
shorter vector counts as padded with zeros; a vec_id that is null takes no part; rows that repeat a vec_id are candidates each on its own, and
each a query with rows of its own if that id is one, to which its twins are candidates; a score beyond the range of a long counts as the end
of that range; a query with no candidate has no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_folder

SCALE, EVERY, K = 256, 50, 5
QUERY_BLOCK = 8192
BLOCK_ROWS = 16384
FIRST_DEPTH = 16


def usable(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id and x, array<double>, of every row that takes part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < float("inf"))))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x")


def matrix(column: pa.ListArray, scale: int, width: int = 0) -> np.ndarray:
    """floor(scale * x) of the rows of a list column, whole numbers as doubles, padded with zeros to the longest (and to width)."""
    ends = np.asarray(column.offsets).astype(np.int64)
    sizes = np.diff(ends)
    flat = np.floor(np.asarray(column.values)[ends[0] : ends[-1]] * scale)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def exact_type(*parts: np.ndarray) -> type:
    """The narrowest type in which inner products of such whole numbers stay exact."""
    most = [float(np.abs(x).max(initial=0)) for x in parts]
    bound = most[0] * most[-1] * max(x.shape[1] for x in parts)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def as_type(x: np.ndarray, kind: type) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape) if kind is object else x.astype(kind)


def in_range(scores):
    """Scores, or a bound of them, as they count: at most the ends of a long."""
    return np.clip(scores, -(1 << 63), (1 << 63) - 1) if getattr(scores, "dtype", object) == object else scores


def best_first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


class SortedLists:
    """One block: its vectors and, for each dimension, the rows in ascending order of that component."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(rows)
        self.rows, self.ids, self.v = rows[order], ids[order], vectors[order]
        self.lists = np.argsort(self.v, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.v.T, self.lists, axis=1)

    def search(self, row: int, query: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """best: scores and ids found before, at most k; returns the k best of those and this block, less the query's own row."""
        scores, ids = best
        n, depth, step = len(self.ids), 0, FIRST_DEPTH
        up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        used = np.concatenate([up, down])
        seen = np.zeros(n, dtype=bool)
        own = np.searchsorted(self.rows, row)
        if own < n and self.rows[own] == row:
            seen[own] = True
        while depth < n:
            stop = min(n, depth + step)
            met = np.concatenate([self.lists[up, depth:stop].ravel(), self.lists[down, n - stop : n - depth].ravel()]) if len(used) else np.arange(n)
            fresh = np.zeros(n, dtype=bool)
            fresh[met] = True
            fresh &= ~seen
            rows = np.flatnonzero(fresh)
            seen |= fresh
            got = in_range(self.v[rows] @ query)
            if len(scores) >= k:
                keep = got >= scores[-1]
                rows, got = rows[keep], got[keep]
            if len(rows):
                scores, ids = np.concatenate([scores, got]), np.concatenate([ids, self.ids[rows]])
                order = best_first(scores, ids, k)
                scores, ids = scores[order], ids[order]
            depth, step = stop, step * 2
            if not len(used) or seen.all():
                break
            bound = in_range(query[up] @ self.values[up, depth - 1] + query[down] @ self.values[down, n - depth])
            if len(scores) >= k and scores[-1] > bound:
                break
        return scores, ids


SCHEMA = "query_row long, query_id long, vec_id long, score long"


def _searcher(shared, k: int, scale: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_rows, query_ids, queries = shared.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(query_rows)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def search() -> None:
            width = max(queries.shape[1], *(v.shape[1] for _, _, v in held))
            wide = [np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in [queries, *(v for _, _, v in held)]]
            vectors = np.concatenate(wide[1:])
            kind = exact_type(wide[0], vectors)
            lists, q = SortedLists(np.concatenate([r for r, _, _ in held]), np.concatenate([i for _, i, _ in held]), as_type(vectors, kind)), as_type(wide[0], kind)
            for j in range(len(query_rows)):
                best[j] = lists.search(int(query_rows[j]), q[j], k, best[j])
            held.clear()

        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), matrix(batch.column(2), scale)))
            if sum(len(i) for i, _, _ in held) >= block_rows:
                search()
        if held:
            search()
        for start in range(0, len(query_rows), 1024):
            part = range(start, min(start + 1024, len(query_rows)))
            rows = [(int(query_rows[j]), int(query_ids[j]), int(i), int(x)) for j in part for x, i in zip(*best[j], strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, query_block: int = QUERY_BLOCK, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every query, a row whose vec_id is divisible by `every`."""
    spark = embeddings.sparkSession
    vectors = materialize(usable(embeddings, scale), "topk-vectors")
    queries, found = new_folder(spark, "topk-queries"), new_folder(spark, "topk-found")
    own = vectors.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-own.count() // query_block))
    own.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(queries)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(f"{found}/block=-1")
    for b in range(blocks):
        block = spark.read.schema("row long, vec_id long, x array<double>, block long").parquet(queries).where(F.col("block") == b).select("row", "vec_id", "x").toArrow().combine_chunks()
        if block.num_rows:
            column = block.column(2).combine_chunks()
            shared = spark.sparkContext.broadcast((np.asarray(block.column(0)), np.asarray(block.column(1)), matrix(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column, scale)))
            near = vectors.mapInArrow(_searcher(shared, k, scale, block_rows), SCHEMA)
            near.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k).write.parquet(f"{found}/block={b}")
            shared.destroy()
    return spark.read.schema(f"{schema}, block int").parquet(found).drop("block")
