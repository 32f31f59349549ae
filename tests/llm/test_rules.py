import random
import re

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import rules


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def cases():
    rng = random.Random(1)
    out = [None, "", " \n\t", "a", "a a a a a a a", "x\x0by\x0cz\r\nq", "é " * 12, "l1\nl1\n l1\n\n\nl1", "a|b <c> #1 $%&*", " x y z", "a b c d e a b c d e f", "1 2 3 4 5 6 1 2 3 4 5 0"]
    for _ in range(150):
        out.append("".join(rng.choice(["the", "of", "é", "x", "##"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randrange(1, 80))))
    return out


def test_measures_against_brute_force():
    for t in cases():
        assert rules.measures(t) == plain(t), t


def test_windows_with_many_distinct_words():
    words = [str(i).encode() for i in range(7000)]
    assert rules.repeated_words(words + words[100:105] + words[3000:3006]) == 22
    assert rules.repeated_words(words) == 0


def clean(rng):
    return " ".join(rng.choice("the and tion of ing er that was with en".split()) + rng.choice("the ing er on at st".split()) for _ in range(rng.randrange(12, 80))) + "."


def test_verdict_follows_the_target(spark):
    rng = random.Random(2)
    good = [(i, clean(rng)) for i in range(300)]
    junk = [(1000 + i, " ".join(w + rng.choice(["###", "$$$", " |"]) for w in clean(rng).split())) for i in range(60)]
    docs = spark.createDataFrame([(*r, 0.0, True) for r in good + junk], "doc_id long, text string, score double, kept boolean")
    target = docs.where("doc_id < 150").select("doc_id")
    for limit in (rules.BROADCAST_IDS, 0):
        rules.BROADCAST_IDS, held = limit, rules.BROADCAST_IDS
        model = rules.ratios(docs, target)
        rules.BROADCAST_IDS = held
        n = np.zeros((2, rules.BUCKETS))
        from docloom.llm.ngrams import grams, plain_bytes

        for i, t in good + junk:
            c = np.bincount(rules.bucket_of(grams([plain_bytes(t)])[0]), minlength=rules.BUCKETS)
            n += [c * (i < 150), c]
        p = (n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * rules.BUCKETS)
        assert np.allclose(model, np.log(p[0] / p[1]), atol=1e-5)
    rows = {r.doc_id: r.v for r in docs.withColumn("v", rules.verdict(docs, model)).select("doc_id", "v").collect()}
    assert all(rows[i].kept or rows[i].base_failed for i, _ in good)
    assert not any(rows[i].kept for i, _ in junk)


def test_odd_rows_and_no_target(spark):
    texts = [*cases(), "word " * 100_000, "a b c d e f g h i j", "a b c d e f g h i j"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = docs.limit(0).select("doc_id")
    model = rules.ratios(docs, none)
    assert not model.any()
    for r in docs.withColumn("v", rules.verdict(docs, model)).select("doc_id", F.col("v.*")).collect():
        want = rules.measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)
    empty = docs.limit(0)
    assert not rules.ratios(empty, none).any() and empty.withColumn("v", rules.verdict(empty, model)).collect() == []
