import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import langid
from docloom.llm.ngrams import grams, letter_bytes, sums_by

WORDS = {"en": "the and tion ing of to ent ers that was".split(), "de": "der die und sch ung ein keit über zu ist".split(), "ru": "что это как для ние ость при его".split()}


def sample(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, sample(rng, lang, rng.randrange(2, 60)), lang) for i, lang in enumerate(list(WORDS) * 60)]


def test_grams_equal_plain_slicing():
    parts = [letter_bytes(t) for t in ("Hello, World 12", "é", None, "a")]
    codes, ends = grams(parts)
    want = [[int.from_bytes(p[i : i + 4], "little") for i in range(len(p) - 3)] for p in parts]
    assert codes.tolist() == [c for w in want for c in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
    assert sums_by(ends, np.ones(len(codes), np.int64)).tolist() == [len(w) for w in want]


def test_filters_hold_every_learned_gram_and_few_others(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    filters = langid.fit(df)
    assert filters.languages == ["de", "en", "ru"]
    for k, lang in enumerate(filters.languages):
        codes = np.unique(grams([letter_bytes(t) for _, t, x in corpus if x == lang])[0])
        others = [np.unique(grams([letter_bytes(t) for _, t, x in corpus if x == o])[0]) for o in filters.languages if o != lang]
        alone = codes[~np.isin(codes, np.concatenate(others))]
        assert (filters.masks(alone)[0] >> np.uint8(k) & 1).all()
        strange = np.random.default_rng(0).integers(0, 2**32, 20_000).astype(np.uint32)
        assert (filters.masks(strange)[0] >> np.uint8(k) & 1).mean() < 0.02


def test_held_out_accuracy_and_odd_rows(spark, corpus):
    train = spark.createDataFrame(corpus, "doc_id long, text string, lang string")
    filters = langid.fit(train.unionByName(spark.createDataFrame([(1, None, "en"), (2, "x y", None)], "doc_id long, text string, lang string")))
    rng = random.Random(9)
    rows = [(i, sample(rng, lang, 8), lang) for i, lang in enumerate(list(WORDS) * 30)]
    odd = [(1000, None, "und"), (1001, "", "und"), (1002, " 12 .. \n", "und"), (1003, "qqqq", "?"), (1004, sample(rng, "de", 40_000), "de")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in df.withColumn("p", langid.language(df, filters)).select("doc_id", "lang", F.col("p.lang").alias("pred"), F.col("p.score").alias("s")).collect()}
    assert sum(got[i].pred == lang for i, _, lang in rows) >= 0.98 * len(rows)
    assert all(0 <= r.s <= 1 for r in got.values())
    for i, _, want in odd:
        assert got[i].pred == want or want == "?" and got[i].pred in filters.languages and got[i].s == 0


def test_without_learning_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    filters = langid.fit(empty)
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert df.select(langid.language(df, filters).alias("p")).first().p.lang == "und"
    assert empty.withColumn("p", langid.language(empty, filters)).collect() == []


def test_more_than_one_plane():
    rng = random.Random(4)
    slots = np.zeros((2, 1024), np.uint64)
    filters = langid.Filters([f"l{i:02}" for i in range(70)], 0, slots, np.zeros(70), np.ones(70))
    text = letter_bytes("abcdef")
    codes = grams([text])[0]
    h = langid.mix64(codes, 0)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(langid.HASHES):
        slots[1, (h + step * np.uint64(i) & np.uint64(1023)).astype(int)] |= np.uint64(1 << 5)
    assert filters.shares([text])[0].argmax() == 69 and rng
