import math
import random

import numpy as np
import pytest

import corpus_pipeline as cp
from docloom.llm import nearcopies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


def plain_classes(texts):
    """Component of every id by comparing all pairs; similarity by sets of word tuples."""

    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = {i: cut(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    common, out = words(rng, 12), [None, "", "  ", "one two", "One  two", "one three"]
    for _ in range(12):
        base = words(rng, rng.randrange(20, 150))
        for _ in range(rng.randrange(1, 7)):
            t = list(base)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = "x" + str(rng.randrange(10**6))
            out.append(" ".join(t + common * rng.randrange(0, 2)))
    rng.shuffle(out)
    return dict(enumerate(out))


def test_classes_against_all_pairs(spark, texts):
    label = plain_classes(texts)
    assert 12 < len(set(label.values())) < len(texts)
    got = nearcopies.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in got} == label


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        frequent = np.sort(rng.choice(a, max(1, n // 3), replace=False))
        for gone in range(n):
            b = np.delete(a, rng.choice(n, gone, replace=False))
            if len(b) >= 0.8 * len(a) - 1e-9:
                meet = [set(nearcopies.prefix(x, frequent, np.full(len(frequent), 9)).tolist()) for x in (a, b)]
                assert meet[0] & meet[1]


def test_stage_drops_near_copies_that_differ_in_many_bits(spark):
    rng = random.Random(4)
    rows, far = [], []
    for i in range(0, 40, 2):
        base = words(rng, 100)
        put = lambda *at: " ".join("other" if j in at else w for j, w in enumerate(base))
        rows += [(i, put(), "en", "s", 1, True), (i + 1, put(20, 70), "en", "s", 1, True)]  # 86 of 106 shingles
        far += [(i, put(), "en", "s", 1, True), (i + 1, put(20, 45, 70), "en", "s", 1, True)]  # 81 of 111
    stage = lambda x: sorted(r.doc_id for r in cp.near_duplicates(spark, spark.createDataFrame(x, COLUMNS), "").collect())
    assert stage(rows) == list(range(0, 40, 2))
    assert stage(far) == list(range(40))


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (None, "a b c d e f"), (None, "lone words"), (5, "a b c d e f")], "doc_id long, text string")
    assert sorted(str((r.doc_id, r.component_id)) for r in nearcopies.near_duplicates(df).collect()) == ["(5, 5)", "(5, 5)", "(None, 5)", "(None, None)"]
    assert nearcopies.near_duplicates(df.limit(0)).collect() == []


def test_stage_and_run_on_whole_rows(spark, tmp_path):
    """The pipeline's own survivors are those of all pairs at 0.8, and run() gives what its stages give one by one."""
    from .test_langid import sample

    rng = random.Random(5)
    rows = []
    for i in range(0, 120, 2):
        t, lang = sample(rng, ("en", "de")[i // 2 % 2], rng.randrange(20, 80)), ("en", "de")[i // 2 % 2]
        more = t + " mail me.x@a.example.com or +1 (206) 555-0100" if i % 3 else t + " "
        rows += [(i, t, lang, "s", len(t), True), (i + 1, more, lang, "s", len(more), True)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    label = plain_classes({r[0]: r[1] for r in rows})
    single = cp.near_duplicates(spark, docs, str(tmp_path))
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {i for i in label if label[i] == i}
    whole = {p.doc_id for p in cp.run(spark, str(tmp_path)).collect()}
    assert whole and whole <= {i for i in label if label[i] == i}


def test_stage_keeps_one_row_without_id_of_a_class(spark):
    texts = [(None, "a b c d e f"), (None, "A b  c d e f"), (None, "a b c d e f"), (None, "other words of ours"), (None, "copy of a known row"), (7, "copy of a known row"), (7, "copy of a known row")]
    rows = [(i, t, "en", "s", 1, True) for i, t in texts]
    got = cp.near_duplicates(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted(" ".join(r.text.lower().split()) for r in got if r.doc_id is None) == ["a b c d e f", "other words of ours"]
    assert [r.text for r in got if r.doc_id == 7] == ["copy of a known row"] and len(got) == 3


def test_pairs_meet_their_prefixes_as_single_rows(spark):
    """The joins of pairs with prefixes make no more rows than there are pairs; which pairs pass is counted plainly."""
    rng = random.Random(6)
    prefixes = {k: rng.sample(range(60), 21 + k % 3) for k in range(30)}
    sizes = {k: 5 * (len(p) - 1) for k, p in prefixes.items()}
    pairs = [(u, v) for u in prefixes for v in prefixes if u < v]
    shared = spark.createDataFrame([(k, sizes[k], h) for k, p in prefixes.items() for h in p], "key long, size int, h long")
    plain = {(u, v) for u, v in pairs if len(set(prefixes[u]) & set(prefixes[v])) >= min(math.ceil(4 / 9 * (sizes[u] + sizes[v]) - 1e-9) - math.ceil(0.8 * sizes[k] - 1e-9) + 1 for k in (u, v))}
    assert 0 < len(plain) < len(pairs)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = nearcopies.promising(spark.createDataFrame(pairs, "u long, v long"), shared, 0.8)
        assert {(r.u, r.v) for r in got.collect()} == plain
        nodes, made = [got._jdf.queryExecution().executedPlan()], []
        for node in nodes:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            made += [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len(made) == 2 and max(made) <= len(pairs)
