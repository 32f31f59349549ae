"""Quality rules: fixed measures of every text, then a log-likelihood ratio of hashed n-grams.

Byte 4-grams (digits as one, white space as one space, case and symbols kept) hash to BUCKETS. Two multinomials are counted over
all rows: the raw corpus, and the documents trusted as target. A document's score is the mean log ratio of its grams under the
two, with PRIOR grams of ratio zero added so that short texts stay near it; below THRESHOLD it is rejected, whatever its neighbours.

Defined cases: null and empty texts have no words, measure zero and fail the fixed rules; without target rows every ratio is zero
and only the fixed rules reject; rows are judged one by one, so repeated rows fare alike; texts of any length are read whole;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PART_ROWS, by_parts, hand_back, materialize, mix64
from .ngrams import plain_bytes, sliced, sums_by

SYMBOLS = b"#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
BUCKETS, SMOOTHING, PRIOR, THRESHOLD = 1 << 16, 0.5, 50, -0.2
#: Target ids that a task may get as a broadcast (8 bytes each); with more, the target is counted from a shuffled join.
BROADCAST_IDS = 1_000_000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of words which occurs twice or more, first occurrences included."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    v = len(known)
    if v == n:
        return 0
    if v**window < 2**63:
        codes = ids[: n - window + 1].copy()
        for k in range(1, window):
            codes = codes * v + ids[k : n - window + 1 + k]
    else:
        codes = ids
        for k in range(1, window):  # ranks of prefixes stay below n, so products stay exact
            codes = np.unique(codes[: n - k], return_inverse=True)[1] * v + ids[k:]
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(codes), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = np.flatnonzero(twice)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(text) - sum(map(text.count, SPACE)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def bucket_of(codes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return (mix64(codes, 7) & np.uint64(buckets - 1)).astype(np.int64)


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in (b.slice(i, PART_ROWS) for b in batches for i in range(0, b.num_rows, PART_ROWS)):
            flags = np.asarray(batch.column(1).to_pylist(), dtype=bool)
            parts = [plain_bytes(t) for t in batch.column(0).to_pylist()]
            for k in (False, True):
                for _, codes, _ in sliced([p for p, f in zip(parts, flags, strict=True) if f == k]):
                    total[int(k)] += np.bincount(bucket_of(codes, buckets), minlength=buckets)
        used = np.flatnonzero(total.any(axis=0))
        yield pa.record_batch([pa.array(used), pa.array(total[1, used]), pa.array(total[:, used].sum(axis=0))], names=["bucket", "target", "raw"])
        hand_back()

    return run


COUNTS = "bucket long, target long, raw long"


def ratios(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of each bucket under the target (rows of docs whose doc_id is in target) and under all of docs; at most BUCKETS numbers reach the driver."""
    ids = materialize(target.select(F.col("doc_id").alias("target_id")).where("target_id IS NOT NULL").distinct(), "rules-target")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if ids.count() <= BROADCAST_IDS:
        flagged = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("target_id"), "left").select("text", F.col("target_id").isNotNull().alias("flag"))
        counted = flagged.mapInArrow(_counter(buckets), COUNTS)
    else:
        raw = texts.select("text", F.lit(False).alias("flag")).mapInArrow(_counter(buckets), COUNTS)
        own = texts.join(ids, F.col("doc_id") == F.col("target_id"), "left_semi").select("text", F.lit(True).alias("flag")).mapInArrow(_counter(buckets), COUNTS)
        counted = raw.unionByName(own.select("bucket", "target", F.lit(0).cast("long").alias("raw")))
    found = counted.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    n = np.zeros((2, buckets))
    for row, name in enumerate(("target", "raw")):
        n[row, np.asarray(found.column("bucket").combine_chunks())] = np.asarray(found.column(name).combine_chunks())
    if not n[0].sum():
        return np.zeros(buckets, np.float32)
    p = (n + smoothing) / (n.sum(axis=1, keepdims=True) + smoothing * buckets)
    return np.log(p[0] / p[1]).astype(np.float32)


def scores(model: np.ndarray, texts: list[str | None], prior: float = PRIOR) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, codes, ends in sliced([plain_bytes(t) for t in texts]):
        n = np.diff(np.concatenate([[0], ends]))
        out[first : first + len(ends)] = sums_by(ends, model[bucket_of(codes, len(model))].astype(np.float64)) / (n + prior)
    return out


VERDICT = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,score:double,base_failed:boolean,kept:boolean>"


def verdict(docs: DataFrame, model: np.ndarray, text: str = "text", threshold: float = THRESHOLD, prior: float = PRIOR) -> Column:
    """The measures, the score and whether a text is kept, see VERDICT."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        values = texts.to_pylist()
        m = np.array([measures(t) for t in values], np.int64).reshape(-1, 5)
        score = scores(shared.value, values, prior)
        failed = (m[:, 0] < LEAST_WORDS) | (100 * m[:, 4] > MOST_REPEATED * m[:, 0])
        columns = [pa.array(m[:, i]) for i in range(5)] + [pa.array(score), pa.array(failed), pa.array(~failed & (score >= threshold))]
        return pa.StructArray.from_arrays(columns, names=[x.split(":")[0] for x in VERDICT[7:-1].split(",")])

    return F.arrow_udf(by_parts(run), VERDICT)(F.col(text).cast("string"))
