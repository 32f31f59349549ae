import random

import numpy as np
import xxhash

from docloom.llm import simhash


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(prints):
    """prints: {doc: fingerprint}; smallest document reachable over links of at most 3 bits."""
    docs = sorted(prints)
    label = {d: d for d in docs}
    changed = True
    near = [(a, b) for i, a in enumerate(docs) for b in docs[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in near:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def walks(rng, n):
    """Fingerprints in chains and balls of a few bits."""
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.append(x)
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
    return out[:n]


def test_index_finds_exactly_the_near_pairs():
    rng = random.Random(1)
    codes = np.array(sorted(set(walks(rng, 400))), np.uint64)
    group = np.array([rng.randrange(3) for _ in codes], np.int64)
    index = simhash.GrayIndex(group, codes)
    got = {(int(index.codes[a]), int(index.codes[b])) for x, y in index.links(3, held=5000) for a, b in zip(x, y, strict=True)}
    want = {(int(a), int(b)) for i, a in enumerate(index.codes) for j, b in enumerate(index.codes) if i < j and index.group[i] == index.group[j] and (int(a) ^ int(b)).bit_count() <= 3}
    assert got == want


def test_masks_cover_all_bits():
    for fixed in (0, 0xFFFF, 0xFFFF << 48, (1 << 63) - 1):
        parts = simhash.sub_masks(fixed, 4)
        assert sum(parts) == ~fixed & (1 << 64) - 1 and all(a & b == 0 for i, a in enumerate(parts) for b in parts[:i])


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "f", 3) for i, t in rows], "doc_id long, text string, fp string, first int")
    return {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, **kw).collect()}


def test_documents_against_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("the of And erin ouEA éa x9 , .".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one two"), (5, "a b c"), (7, "long " * 30_000)]
    for i in range(120):
        w = rng.choice(base).split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((100 + i, " ".join(w)))
    prints = {i: plain_fingerprint(t) for i, t in rows}
    label = plain_classes(prints)
    assert run(spark, rows) == {(i, f"{prints[i]:016x}", label[i]) for i, _ in rows}
    assert run(spark, rows, group_rows=16) == {(i, f"{prints[i]:016x}", label[i]) for i, _ in rows}


def test_edges_keep_every_link_when_groups_are_dealt_again(spark):
    rng = random.Random(3)
    codes = sorted(set(walks(rng, 300)))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    label = plain_classes(dict(zip(signed, codes, strict=True)))
    for rows, held in ((8192, 200_000), (8, 10)):
        df = spark.createDataFrame([(c,) for c in signed], "fp long")
        roots = {r.node: r.root for r in simhash.connected(simhash.near_edges(df, group_rows=rows, held_rows=held)).collect()}
        assert {c: roots.get(c, c) for c in signed} == label


def test_null_ids_repeats_and_no_rows(spark):
    assert run(spark, []) == set()
    f = f"{plain_fingerprint('a b c'):016x}"
    assert run(spark, [(None, "a b c"), (4, "A B C"), (4, "a  b c")]) == {(None, f, 4), (4, f, 4)}
    assert run(spark, [(None, "a b c")]) == {(None, f, None)}
