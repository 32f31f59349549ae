import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import divergence
from docloom.llm.queries import QUERIES


def plain(rows, least=30, top=50):
    groups, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in [tuple(x or "" for x in r) for r in rows]:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own = {s: shares(groups[lang, s]) for s in sources}
        usual = shares(sum((groups[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, own[s][t] - usual[t]) for t in kept if groups[lang, s][t] and own[s][t] > usual[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def made(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["a", "ab", "abc", "abcd", "abcde", "abcdefgh", "abcdefghi", "É", "éa", "漢字", "x" * 16, "x" * 17, "y" * 40, "Zeta", "zETA"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, [1 / (k + 1 + i % 3) for k in range(len(vocabulary))], k=rng.randrange(0, 40))
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s1", "s2", "é", None]), rng.choice([" ", "-", "\n9", "_"]).join([*words, f"rare{'q' * (i % 30)}"])))
    return rows + [("lone", "s", "only words"), ("none", "a", None), ("none", "b", ""), ("de", "silent", "1 2 3"), ("en", "s0", "Zeta " * 50_000), ("en", "s0", "z" * 100_000)]


@pytest.mark.parametrize(("first", "tile", "chunk", "top"), [(4, 128, 2048, 50), (1, 2, 3, 7)])
def test_equals_plain_counts(spark, first, tile, chunk, top):
    rows = made(600)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "lang string, source string, text string, term string, n int, place int").repartition(5)
    found = divergence.audit(df, top=top, first_length=first, tile=tile, chunk=chunk)
    assert sorted(map(tuple, found.collect())) == plain(rows, top=top)


def test_full_map_keeps_results_exact(spark, monkeypatch):
    """A map that says yes to all prunes nothing; the counts still decide."""
    monkeypatch.setattr(divergence, "bitmap_of", lambda kept: kept.sparkSession.sparkContext.broadcast(np.full(1 << (divergence.MAP_BITS - 6), 2**64 - 1, np.uint64)))
    rows = made(300, 2)
    found = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"))
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_prefixes_are_discarded_level_by_level():
    w = divergence.words([b"abcdef abcxyz ab", b"abcdef q"])
    assert w.terms.to_pylist() == [b"abcdef", b"abcxyz", b"ab", b"q"] and w.doc.tolist() == [0, 0, 0, 1, 1]
    prefixes, n = divergence.prefix_counts(w, "en", 3, 0, None)
    assert dict(zip(prefixes.to_pylist(), n.tolist(), strict=True)) == {b"abc": 2, b"ab": 1, b"q": 1}
    bitmap = np.zeros(1 << (divergence.MAP_BITS - 6), np.uint64)
    at = divergence.slots([b"abc"], "en")
    bitmap[at >> np.uint64(6)] |= np.uint64(1) << (at & np.uint64(63))
    prefixes, n = divergence.prefix_counts(w, "en", 6, 3, bitmap)
    assert dict(zip(prefixes.to_pylist(), n.tolist(), strict=True)) == {b"abcdef": 2, b"abcxyz": 1}
    assert len(divergence.prefix_counts(w, "de", 6, 3, bitmap)[0]) == 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["op13_divergence"](spark, str(tmp_path)).collect() == []
