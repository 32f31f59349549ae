import random

import pytest

import corpus_pipeline as cp
from docloom.llm import packing, rules

from .test_langid import sample
from .test_nearcopies import plain_classes
from .test_pii import plain as plain_pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(240):
        lang = rng.choice(["en", "de", "ru"])
        t = sample(rng, lang, rng.randrange(20, 80))
        if i % 9 == 1:
            t = " ".join(w + "###" for w in t.split())
        if i % 9 == 2:
            t, lang = out[-2][1] + " " * (i % 2), out[-2][2]
        if i % 11 == 3:
            t += " mail me.x@a.example.com or +1 (206) 555-0100"
        out.append((i, t, lang, "s", len(t), True))
    return out + [(1000, None, None, None, None, None), (1001, "", "en", "s", 0, None), (1002, "3 4 5 6 7 8 9 10 11 12 13 14 15", "en", "s", 5, None), (None, sample(rng, "en", 30), None, "s", 1, None)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 1), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(cp.STAGES)

    kept = stage["quality rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {r[0] for r in rows if r[1] and rules.measures(r[1])[0] >= 10 and "###" not in r[1]}
    assert clean - {1002} <= ids and not {1000, 1001} & ids and not any("###" in r[1] for r in rows if r[0] in ids)

    known = stage["language ID"](spark, kept, folder)
    assert known.columns == docs.columns
    langs = {r.doc_id: r.lang for r in known.collect()}
    assert set(langs) == ids - {1002} and all(langs[r[0]] == r[2] for r in rows if r[2] and r[0] in langs) and langs[None] == "en"

    single = stage["near duplicates"](spark, known, folder)
    text = {r[0]: r[1] for r in rows}
    label = plain_classes({i: text[i] for i in langs if i is not None})
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {i for i in label if label[i] == i} | {None}

    private = stage["personal data"](spark, single, folder)
    assert private.columns == docs.columns
    got = {r.doc_id: r for r in private.collect()}
    assert set(got) == {r.doc_id for r in single.collect()}
    for i, r in got.items():
        assert "@" not in r.text and "555" not in r.text
        assert r.text == text[i] if i is not None and not plain_pii(text[i]) else "[EMAIL]" in r.text or i is None
        assert i is None or r.n_chars == len(r.text)

    pieces = stage["packing"](spark, private, folder).collect()
    assert {p.doc_id for p in pieces} == set(got) and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    whole = cp.run(spark, folder).collect()
    key = lambda p: (str(p.doc_id), p.start if p.length == packing.CAPACITY else -1, p.doc_tokens)
    assert sorted({key(p) for p in whole}) == sorted({key(p) for p in pieces})


def test_repeated_rows_and_empty_table(spark, rows, folder):
    twice = spark.createDataFrame([rows[0], rows[0], (0, "other words here", "en", "s", 3, None), rows[4]], COLUMNS)
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, twice, folder).collect()) == [0, 4]
    docs = spark.createDataFrame([], COLUMNS)
    for _, f in cp.STAGES:
        docs = f(spark, docs, folder)
        assert docs.collect() == []
