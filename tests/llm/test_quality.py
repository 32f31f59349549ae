import random
import re

import numpy as np

from docloom.llm import quality


def test_tokens_are_runs_of_one_kind():
    texts = ["Hello, wörld 12 345###", "", "a a\tb", "12 345 9", "Hello"]
    t, ends = quality.tokens([x.encode() for x in texts])
    parts = np.split(t, ends[:-1])
    runs = [re.findall(r"[^\W\d_]+|\d+|[^\w\s]+", x) for x in texts]
    assert [len(p) for p in parts] == [len(r) for r in runs]
    seen = {}
    for p, r in zip(parts, runs, strict=True):
        for b, w in zip(p, r, strict=True):
            assert seen.setdefault("0" if w.isdigit() else w, b) == b
    assert len(set(seen.values())) == len(seen)
    long = "x" * 5000
    assert quality.tokens([long.encode()])[0][0] != quality.tokens([(long + "x").encode()])[0][0]


def good(rng):
    return " ".join(rng.choice("the and tion of ing er that was with en".split()) + rng.choice(["", "ing", "er"]) for _ in range(rng.randrange(8, 90))) + "."


def bad(rng):
    w = good(rng).split()
    return " | ".join(w) if rng.random() < 0.5 else " ".join([w[0]] * 30)


def test_held_out_accuracy_and_calibration(spark):
    rng = random.Random(1)
    rows = [(i, (good if i % 3 else bad)(rng), int(i % 3 > 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "s", 0.1) for i, t, _ in rows], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 600] + [(None, 1), (3, None)], "doc_id long, label int")
    vectors = quality.word_vectors(docs)
    network = quality.fit(docs, labels, vectors)
    got = {r.doc_id: r.p for r in docs.withColumn("p", quality.score(docs, vectors, network)).select("doc_id", "p").collect()}
    p, y = np.array([got[i] for i in range(600, 900)]), np.array([y for i, _, y in rows if i >= 600])
    assert ((p >= 0.7) == y).mean() > 0.97 and ((0 <= p) & (p <= 1)).all()
    assert abs(p.mean() - y.mean()) < 0.05


def test_bound_on_labelled_rows_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x"), (3, "x"), (4, "w " * 100_000), (None, "a b")], "doc_id long, text string")
    vectors = quality.word_vectors(docs)
    none = spark.createDataFrame([], "doc_id long, label int")
    for labels, prior in ((none, 0.5), (spark.createDataFrame([(3, 1)], "doc_id long, label int"), 1.0)):
        network = quality.fit(docs, labels, vectors)
        assert [r.p for r in docs.withColumn("p", quality.score(docs, vectors, network)).collect()] == [prior] * 6
    both = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, label int")
    network = quality.fit(docs, both, vectors)
    scores = [r.p for r in docs.withColumn("p", quality.score(docs, vectors, network)).collect()]
    assert scores[2] == scores[3] and all(0 <= s <= 1 for s in scores)
    assert quality.fit(docs, both, vectors, most=1).layers is None
    empty = docs.limit(0)
    assert not quality.word_vectors(empty).any() and empty.withColumn("p", quality.score(empty, vectors, network)).collect() == []


def test_pool_of_empty_texts():
    v = np.ones((quality.BUCKETS, quality.DIMENSIONS), np.float32)
    x = quality.pooled(v, ["", None, "a b", ""])
    assert not x[[0, 1, 3]].any() and x[2, 0] == 1


def test_context_vectors_equal_plain_sums(spark):
    text = "a b c a d ; b a"
    t, _ = quality.tokens([text.encode()])
    places, signs = quality.index_vectors()
    index = np.zeros((quality.BUCKETS, quality.DIMENSIONS))
    for b in range(quality.BUCKETS):
        np.add.at(index[b], places[b], signs[b])
    want, n = np.zeros_like(index), np.zeros(quality.BUCKETS)
    for i, b in enumerate(t):
        n[b] += 1
        for j in range(max(0, i - 2), min(len(t), i + 3)):
            if j != i:
                want[b] += index[t[j]]
    want = want / np.maximum(n, 1)[:, None]
    want -= (want * n[:, None]).sum(axis=0) / n.sum()
    want[n == 0] = 0
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(spark.createDataFrame([(text,)], "text string")), want, atol=1e-5)
