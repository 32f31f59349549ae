"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Tokens are runs of letters, of digits (all alike) or of other marks, hashed to BUCKETS. Every bucket has a sparse index vector of
DIMENSIONS with NONZERO entries of one or minus one, drawn by hash; its word vector is the sum of the index vectors met within
NEIGHBOURS tokens on either side over the whole corpus, brought to unit length after the corpus mean is taken off. A document is
the mean and the spread of its tokens' vectors, the length of that mean, its size, and how alike neighbouring vectors are. A network with one hidden layer is fitted
on at most LABELLED labelled rows (those with the smallest hash of their id) and a temperature, chosen on a quarter of them that
the fit doesn't see, calibrates its probabilities.

Defined cases: null and empty texts are scored like any other, from an empty pool; without labelled rows, or with one label only,
every score is the share of label 1 (a half without rows); rows are scored one by one, so repeated rows score alike; a labelled
document that occurs repeatedly counts as often; texts of any length are read whole; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PART_ROWS, by_parts, materialize, mix64, slices

BUCKETS, DIMENSIONS, NONZERO, NEIGHBOURS = 1 << 13, 32, 4, 2
LABELLED, HIDDEN, EPOCHS, BATCH, RATE, DECAY = 20_000, 64, 120, 256, 3e-3, 1e-3
SLICE_BYTES = 1 << 19

# Kinds of bytes: 0 space, 1 letter (and all beyond ASCII), 2 digit, 3 other marks.
KIND = np.array([0 if b in b" \t\n\r\x0b\x0c" else 2 if 48 <= b <= 57 else 1 if b >= 128 or chr(b).isalpha() else 3 for b in range(256)], np.uint8)
PRIME = 0x100000001B3


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[1], np.full(n - 1, PRIME)]).astype(np.uint64))


_POWERS = _powers(1 << 12)


def tokens(parts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each token end to end, where those of each part end)."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    kind = KIND[raw]
    edge = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    start = edge[kind[edge] > 0]
    stop = np.append(edge, len(raw))[np.searchsorted(edge, start) + 1]
    value = np.where(kind == 2, 48, raw).astype(np.uint64) + np.uint64(1)
    lead = np.arange(len(raw)) - np.repeat(edge, np.diff(np.append(edge, len(raw))))  # place of each byte in its run
    power = _POWERS[np.minimum(lead, len(_POWERS) - 1)] if lead.max(initial=0) < len(_POWERS) else _powers(int(lead.max()) + 1)[lead]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power)])
    hashed = np.where(kind[start] == 2, np.uint64(1), total[stop] - total[start])
    ends = np.searchsorted(start, np.cumsum(sizes + 1))
    return (mix64(hashed, 3) & np.uint64(buckets - 1)).astype(np.int64), ends


def index_vectors(buckets: int = BUCKETS, dimensions: int = DIMENSIONS, nonzero: int = NONZERO) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's nonzero entries (places may coincide)."""
    h = mix64(np.arange(buckets * nonzero), 11).reshape(buckets, nonzero)
    return (h % np.uint64(dimensions)).astype(np.int64), np.where(h >> np.uint64(63), 1, -1).astype(np.int64)


def _sliced(texts: list[str | None]):
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    for a, b in slices([len(p) for p in parts], SLICE_BYTES):
        yield a, *tokens(parts[a:b])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total, seen = np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS, np.int64)
    for batch in (b.slice(i, PART_ROWS) for b in batches for i in range(0, b.num_rows, PART_ROWS)):
        for _, t, ends in _sliced(batch.column(0).to_pylist()):
            seen += np.bincount(t, minlength=BUCKETS)
            part = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
            for o in range(1, NEIGHBOURS + 1):
                same = part[o:] == part[:-o]
                for a, b in ((t[o:][same], t[:-o][same]), (t[:-o][same], t[o:][same])):
                    for j in range(NONZERO):
                        total += np.bincount(a * DIMENSIONS + places[b, j], signs[b, j], BUCKETS * DIMENSIONS)
    used = np.flatnonzero(seen)
    v = total.reshape(BUCKETS, DIMENSIONS).astype(np.int64)[used]
    yield pa.record_batch([pa.array(used), pa.array(seen[used]), *(pa.array(v[:, i]) for i in range(DIMENSIONS))], names=["bucket", "n", *(f"v{i}" for i in range(DIMENSIONS))])


CONTEXTS = ", ".join(["bucket long", "n long", *(f"v{i} long" for i in range(DIMENSIONS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all buckets from every row of docs; the driver receives BUCKETS rows at most."""
    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_contexts, CONTEXTS)
    found = found.groupBy("bucket").agg(F.sum("n").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIMENSIONS)]).toArrow()
    v, n = np.zeros((BUCKETS, DIMENSIONS)), np.zeros(BUCKETS)
    at = np.asarray(found.column("bucket").combine_chunks())
    v[at] = np.stack([np.asarray(found.column(f"v{i}").combine_chunks()) for i in range(DIMENSIONS)], axis=1)
    n[at] = np.asarray(found.column("n").combine_chunks())
    v = v / np.maximum(n, 1)[:, None]
    v -= (v * n[:, None]).sum(axis=0) / max(1, n.sum())
    v[n == 0] = 0
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Mean, spread, length of the mean (plain, and against the size), log size, and mean likeness of neighbours one and two apart."""
    d = vectors.shape[1]
    out = np.zeros((len(texts), 2 * d + 5))
    for first, t, ends in _sliced(texts):
        n = np.diff(np.concatenate([[0], ends]))
        full = np.flatnonzero(n)
        if len(full):
            w = vectors[t]
            begin = np.concatenate([[0], ends])[:-1][full]
            mean = np.add.reduceat(w, begin, axis=0, dtype=np.float64) / n[full, None]
            square = np.add.reduceat(w * w, begin, axis=0, dtype=np.float64) / n[full, None]
            length = np.linalg.norm(mean, axis=1)
            part = np.repeat(np.arange(len(ends)), n)
            alike = []
            for o in (1, 2):
                same = part[o:] == part[:-o]
                dots = np.where(same, np.einsum("ij,ij->i", w[o:], w[:-o]), 0)
                alike.append((np.bincount(part[o:], dots, len(ends)) / np.maximum(n - o, 1))[full])
            out[first + full] = np.column_stack([mean, np.sqrt(np.maximum(square - mean**2, 0)), length, length * np.sqrt(n[full]), np.log1p(n[full]), *alike])
    return out


@dataclass
class Network:
    """p(label 1) = sigmoid((tanh(x W1 + b1) W2 + b2) / temperature) over standardised features; without layers a constant."""

    prior: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    layers: list[np.ndarray] | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(np.clip((x - self.mean) / self.spread, -8, 8) @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, check: np.ndarray) -> Network:
    """Adam on the logistic loss over rows not in check; the temperature is the one of a grid with least loss on check."""
    if len(y) == 0 or y.min() == y.max():
        return Network(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(17)
    own = ~check if 0 < y[~check].sum() < (~check).sum() else np.ones(len(y), bool)
    mean, spread = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z, t = np.clip((x[own] - mean) / spread, -8, 8), y[own].astype(float)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, s, step = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for i in range(0, len(order), BATCH):
            xi, ti = z[order[i : i + BATCH]], t[order[i : i + BATCH]]
            h = np.tanh(xi @ layers[0] + layers[1])
            g = (1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3], -40, 40))) - ti) / len(ti)
            back = np.outer(g, layers[2]) * (1 - h * h)
            step += 1
            for k, grad in enumerate((xi.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()]))):
                grad = grad + DECAY * layers[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad**2
                layers[k] = layers[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(float(y.mean()), mean, spread, layers)
    judged = check if check.any() else np.ones(len(y), bool)
    logits, t = net.logits(x[judged]), y[judged]
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.logaddexp(0, np.where(t == 1, -1, 1) * np.clip(logits / k, -40, 40)).mean() for k in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _features(docs: DataFrame, vectors: np.ndarray) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    return F.arrow_udf(by_parts(lambda texts: pa.array(list(pooled(shared.value, texts.to_pylist())), pa.list_(pa.float64()))), "array<double>")(F.col("text").cast("string"))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = LABELLED) -> Network:
    """labels: doc_id, label (0 or 1), already without held-out rows; at most `most` of them are used, chosen by hash of the id."""
    chosen = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = materialize(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").alias("labelled_id"), "label"), "quality-labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    ranked = rows.select("doc_id", "label", _features(docs, vectors).alias("x"))
    # A sampled id may stand for several rows; the smallest `most` rows by hash bound what the driver receives.
    found = ranked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow()
    if not found.num_rows:
        return Network(0.5)
    x = np.array(found.column("x").to_pylist())
    check = (mix64(np.asarray(found.column("doc_id").combine_chunks()), 5) & np.uint64(3)) == 0
    return fit_network(x, np.asarray(found.column("label").combine_chunks()).astype(int), check)


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> Column:
    """Probability of label 1 for the text column of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(texts: pa.Array) -> pa.Array:
        v, net = shared.value
        return pa.array(net.probability(pooled(v, texts.to_pylist())))

    return F.arrow_udf(by_parts(run), "double")(F.col("text").cast("string"))
