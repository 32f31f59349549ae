"""Names as heard, key points and nested totals against plain readings."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from docloom.operators import names as N
from docloom.operators import tables as T
from docloom.plans import name_queries as Q

SF = "/root/testdata/sf0.001"


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 1] + b[j - 2]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def nearest(words, lexicon):
    out = set()
    known = {w for w in lexicon if w and 1 < len(w) <= N.MOST_LETTERS}
    for w in {w for w in words if w and 1 < len(w) <= N.MOST_LETTERS} - known:
        found = []
        for t in known:
            limit = 2 if len(t) >= 7 else 1
            if abs(len(w) - len(t)) <= limit and (w[0] == t[0] or any(w[0] in g and t[0] in g for g in N.ONSETS)) and (d := osa(w, t)) <= limit:
                found.append((d, t))
        found.sort()
        if found and (len(found) == 1 or found[0][0] < found[1][0]):
            out.add((w, found[0][1], found[0][0]))
    return out


def test_distance():
    assert [N.aligned_distance(*p) for p in (("", ""), ("abc", ""), ("ca", "abc"), ("ab", "ba"), ("kelmora", "kemora"), ("abcd", "badc"))] == [0, 3, 3, 1, 1, 2]
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in "ab")
        assert N.aligned_distance(a, b) == osa(a, b)


def test_corrections_equal_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("vwabeiouls") for _ in range(n))
    lexicon = [make(rng.randrange(2, 11)) for _ in range(150)] + ["x" * 41, None, "a", "kelmora", "torinas"]

    def bent(w):
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("vwabel") + w[i:], w[:i] + rng.choice("sol") + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]]) or "v"
        return w

    words = [bent(rng.choice([w for w in lexicon if w and len(w) < 40])) for _ in range(900)] + ["y" * 41, "x" * 42, None, "", "kemora", "kelmora", "eklmora"]
    of = lambda rows: spark.createDataFrame([(w, 1) for w in rows], "word string, edits int").repartition(3)
    got = {tuple(r) for r in N.corrections(of(words), of(lexicon)).collect()}
    assert got == nearest(words, lexicon) and len(got) > 100 and ("kemora", "kelmora", 1) in got
    assert N.corrections(of([]), of(lexicon)).collect() == [] and N.corrections(of(words), of([])).collect() == []


def test_heard_names(spark):
    df = spark.createDataFrame([("Kelmoras met McKelmoras, KELMORAS and Étorina Jane's Torinanes",), (None,)], "t string")
    assert [r[0] for r in df.select(N.heard_names(df.t)).collect()] == [["Kelmoras", "Torinanes"], []]


@pytest.mark.skipif(not Path(SF).exists(), reason="the tables aren't here")
def test_heard_names_of_the_tables(spark):
    import re

    read = lambda name: [r.text for r in spark.read.parquet(f"{SF}/{name}.parquet").collect() if r.text]
    heard = Counter(w.lower() for t in read("documents") + read("conversations") for w in re.findall("(?<![A-Za-z])[A-Za-z]+(?![A-Za-z])", t) if re.fullmatch("[A-Z][a-z]{7,}", w))
    lexicon = {w.lower() for t in read("benchmark") for w in re.findall("[A-Za-z]+", t) if len(w) >= 5}
    got = {(r.word, r.target, r.edits, r.n) for r in Q.jn21_heard_names(spark, SF).collect()}
    assert got == {(w, t, d, heard[w]) for w, t, d in nearest(heard, lexicon)} and got


def merged(rows, most):
    kept = []
    for text, sources in rows:
        if text is None or not text.strip(" ") or len(kept) == most:
            continue
        own = N.point_words(text)
        same = next((k for k in kept if own and k[1] and (own <= k[1] or k[1] <= own or len(own & k[1]) / len(own | k[1]) >= 0.75)), None)
        if same:
            same[2].extend(s for s in dict.fromkeys(sources or []) if s not in same[2])
        else:
            kept.append((text.strip(" "), own, list(dict.fromkeys(sources or []))))
    return [(i, t, s) for i, (t, _, s) in enumerate(kept)]


def test_key_points_in_order(spark):
    rng = random.Random(3)
    words = ["Revenue", "rose", "to", "₹4,210", "crore.", "in", "FY24", "margin", "लाभ", "12%"]
    rows = [(k, i, rng.choice([None, "", " . "] + [" ".join(rng.sample(words, rng.randrange(2, 8))) for _ in range(9)]), rng.choice([None, [rng.randrange(5)], [1, 1, 2]])) for k in range(30) for i in range(rng.randrange(25))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "key long, pos long, text string, sources array<long>, place int").repartition(4)
    for most in (8, 3):
        got = defaultdict(list)
        for r in sorted(N.merged_points(df, most).collect(), key=lambda r: (r.key, r.place)):
            got[r.key].append((r.place, r.text, r.sources))
        for k in range(30):
            assert got[k] == merged([r[2:] for r in sorted(r for r in rows if r[0] == k)], most) if any(r[0] == k for r in rows) else not got[k]
    assert N.merged_points(df.limit(0)).collect() == []


def plain_totals(rows):
    working, out = [], {}
    for key, label, section, cells in rows:
        out[key] = (False, 0, [])
        if section:
            continue
        for k in range(2, len(working) + 1):
            checked = 0
            for col, (v, decimals, unit) in cells.items():
                have = [c[col] for _, c in working[-k:] if col in c]
                if not unit.startswith(("currency", "count", "none")) or len(have) < 2:
                    continue
                slack = min(0.5 * 10 ** -max([decimals] + [h[1] for h in have]) * len(have), 0.002 * abs(v)) + 1e-9
                if any(h[2] != unit for h in have) or abs(sum(h[0] for h in have) - v) > slack:
                    checked = -1
                    break
                checked += 1
            if checked > 0 and (label in ("Total", "Sub-total") or checked > 1 or k > 2):
                out[key] = (True, checked, [p for p, _ in working[-k:]])
                working = working[:-k]
                break
        working.append((key, cells))
    return out


def test_nested_totals(spark):
    rng, data, want = random.Random(4), [], {}
    for table in range(60):
        rows, open_, columns = [], [], rng.randrange(1, 4)
        units = [rng.choice(["currency:INR", "count", "percent", "currency:USD"]) for _ in range(columns)]
        for i in range(rng.randrange(0, 14)):
            if open_ and len(open_) > 1 and rng.random() < 0.4:
                n = rng.randrange(2, len(open_) + 1)
                cells = {c: (float(sum(o[c][0] for o in open_[-n:] if c in o) + rng.choice([0, 0, 0, 1])), 0, units[c]) for c in range(columns)}
                open_ = open_[:-n]
            else:
                cells = {c: (float(rng.randrange(-20, 900)), 0, units[c]) for c in range(columns) if rng.random() < 0.9}
            open_.append(cells)
            rows.append((f"r{i}", rng.choice(["Total", "Sub-total", "Other", "Totals due"]), rng.random() < 0.05, cells))
        want |= {(table, k): v for k, v in plain_totals(rows).items()}
        data += [(table, i, k, label, section, [(c, *v) for c, v in cells.items()] + [(9, None, 0, "count")]) for i, (k, label, section, cells) in enumerate(rows)]
    df = spark.createDataFrame(data, "table_id long, row int, key string, label string, section boolean, values array<struct<col:int,value:double,decimals:int,unit:string>>").repartition(4)
    got = {(r.table_id, r.key): (r.is_total, r.columns, r.parts) for r in T.nested_totals(df).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 40
    nested = [v for (t, k), v in want.items() if any(want[t, p][0] for p in v[2])]
    assert len(nested) > 5


def test_totals_of_odd_rows(spark):
    shape = "table_id long, row int, key string, label string, section boolean, values array<struct<col:int,value:double,decimals:int,unit:string>>"
    one = lambda v: [(1, float(v), 0, "count")]
    df = spark.createDataFrame([(1, 1, "a", None, None, one(3)), (1, 2, "b", "", None, None), (1, 3, "c", "x", None, one(4)), (1, 4, "d", "Total", None, one(7)), (2, 1, "a", "Total", None, one(7))], shape)
    got = {(r.table_id, r.key): r.parts for r in T.nested_totals(df).collect()}
    assert got[1, "d"] == ["a", "b", "c"] and got[2, "a"] == [] and T.nested_totals(df.limit(0)).collect() == []


def test_words_in_every_label(spark):
    rows = [("a", ["x", "net", "b"]), ("a", ["net", "c", "x"]), ("b", ["net"]), ("b", []), ("c", ["one"]), (None, ["p", "q"]), (None, ["q"]), ("d", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, w array<string>")
    got = {r.i: (r.own, r.shared) for r in N.own_words(df, "g", "w").collect()}
    assert got == {0: (["b"], ["net", "x"]), 1: (["c"], ["net", "x"]), 2: (["net"], []), 3: ([], []), 4: ([], ["one"]), 5: (["p"], ["q"]), 6: ([], ["q"]), 7: ([], [])}
