"""Searches of the core against plain versions, with odd rows and in several blocks."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import catalog, retrieval, shared


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("block", [4096, 7])
def test_dense_with_odd_vectors(spark, block):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(rng.choice([3, 4]))]) for i in range(120)] + [(200, None), (201, [1.0, None]), (202, []), (203, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = rows_of(retrieval.dense_topk(df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), df, k=4, block=block), "query_id", "vec_id", "score", "rank")
    used = {i: np.array((v + [0.0] * 4)[:4]) for i, v in rows if v is not None and None not in v}
    unit = {i: v / n if (n := np.linalg.norm(v)) else v for i, v in used.items()}
    want = []
    for q in used:
        if q % 5 == 0:
            best = sorted((-round(float(unit[q] @ unit[i]), 6) + 0.0, i) for i in used if i != q)[:4]
            want += [(q, i, -s + 0.0, r + 1) for r, (s, i) in enumerate(best)]
    assert [(a, b, round(c, 6) + 0.0, d) for a, b, c, d in got] == sorted(want)


@pytest.mark.parametrize("block", [512, 3])
def test_sparse_with_a_word_in_every_text(spark, block):
    rng = random.Random(2)
    docs = [(i, ["the", *(rng.choice("abcdefg") for _ in range(rng.randrange(0, 9)))]) for i in range(2500)] + [(5000, []), (5001, None)]
    queries = [(q, t, float(rng.randrange(1, 4))) for q in range(10) for t in rng.sample(["the", *"abcdxyz"], 4)]
    d, q = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3), spark.createDataFrame(queries, "item_id long, token string, weight double")
    for share in (False, True):
        want = []
        for item in range(10):
            w = {t: x for i, t, x in queries if i == item}
            score = {i: sum(x * (min(1, v.count(t)) if share else v.count(t)) for t, x in w.items()) / (sum(w.values()) if share else 1) for i, v in docs if v}
            want += [(item, i, round(-s, 6), r + 1) for r, (s, i) in enumerate(sorted((-round(s, 6), i) for i, s in score.items() if s > 0)[:5])]
        assert rows_of(retrieval.sparse_topk(q, d, "item_id", "doc_id", 5, digits=6, share=share, block=block), "item_id", "doc_id", "score", "rank") == sorted(want)


def test_containment_both_ways(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta".split())
    texts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(60)] + [None, "", "Alpha  BETA gamma"]
    needles = [" ".join(texts[i].split()[2 : 2 + n]).upper() for i, n in ((1, 9), (2, 7), (3, 6), (4, 3), (5, 2), (6, 1), (1, 9))] + [None, "", "pha bet", "beta gamma delta epsilon zeta none of it"]
    d = spark.createDataFrame([(i, "en", t) for i, t in enumerate([*texts, texts[1]])], "doc_id long, lang string, text string")
    e = spark.createDataFrame(list(enumerate(needles)), "item_id long, text string")
    want = sorted((i, j) for i, n in enumerate(needles) for j, t in enumerate([*texts, texts[1]]) if n is not None and t is not None and n.lower() in t.lower())
    assert rows_of(catalog.contained(e, d), "item_id", "doc_id") == want
    assert rows_of(catalog.contained(e, d, most=0), "item_id", "doc_id") == want
    assert catalog.contained(e.limit(0), d).collect() == []


def test_numbering_large_groups_by_ranges(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k string, v int").repartition(7)
    got = {r.id: r.place for r in shared.numbered(df, ["k"], [F.desc("v"), F.col("id")], "place").collect()}
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    assert shared.numbered(df.limit(0), ["k"], [F.col("id")], "place").collect() == []


def test_dense_search_holds_few_scores_at_once():
    rng = np.random.default_rng(4)
    v, ids = rng.integers(-1, 2, (10_000, 8)).astype(np.float32), rng.permutation(10_000)
    batch = pa.record_batch([pa.array(ids), pa.array(list(v), pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    full = retrieval.unit(batch.column(1))
    tracemalloc.start()
    score, item = retrieval.best_items(iter([batch.slice(0, 6_000), batch.slice(6_000)]), ids[:3000], full[:3000], 8, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all scores of the batch at once are 240 MB
    for i in range(0, 3000, 37):
        all_ = np.round(full @ full[i], 6)
        best = [x for x in np.lexsort((ids, -all_)) if ids[x] != ids[i]][:8]
        assert item[i].tolist() == ids[best].tolist() and np.allclose(score[i], all_[best])
