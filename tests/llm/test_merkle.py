import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle
from docloom.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(nodes, arity):
    """The root of nodes and each leaf's siblings, level by level: (those to its left, those to its right)."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        groups = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for leaf, i in enumerate(at):
            own, digit = groups[i // arity], i % arity
            paths[leaf].append((own[:digit], own[digit + 1 :]))
        nodes, at = [h(*g) for g in groups], [i // arity for i in at]
    return nodes[0], paths


def whole(rows, arity=2):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of (doc_id, source, lang, n_chars, text) rows."""
    trees, out = {}, []
    for r in rows:
        leaf = h(*map(field, r))
        n = r[3] if r[3] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 else r[3] + 1
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, r[0], h(*map(field, (*r[:3], n, r[4])))))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = [plain([x[2] for x in sorted(trees[lang])], arity) for lang in langs]
    root, upper = plain([m[0] for m in made], arity) if made else ("", [])
    for lang, (subroot, paths), above in zip(langs, made, upper, strict=True):
        for (_, _, leaf, doc, claim), path in zip(sorted(trees[lang]), paths, strict=True):
            folded = claim
            for left, right in path + above:
                folded = h(*left, folded, *right)
            out.append((doc, leaf, subroot, root, h(*(d for left, right in path + above for d in left + right)), folded, folded == root))
    return sorted(out, key=str)


def table(spark, tmp_path, rows):
    names = "doc_id long, source string, lang string, n_chars long, text string, tree string, rank int, digest string, path string"
    spark.createDataFrame([(*r, "x", 7, "y", "z") for r in rows], names).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


ODD = [
    (None, "s", "en", 3, "no id"), (None, "s", "en", 4, "no id either"), (7, None, None, None, None), (8, "s", None, 1, ""), (21, "s", "", 5, "empty lang"),
    (5, "é漢", "fr", 2, "漢" * 40_000), (5, "é漢", "fr", 2, "漢" * 40_000), (5, "other", "fr", 2, "same id"), (-3, "s", "~", 9, "negative"),
]


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_query_equals_plain_trees(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "en", "en", "de", f"x{i % 9}"]), rng.choice([None, i]), f"text {i % 11}") for i in range(n)] + (ODD if n != 1 else [])
    found = QUERIES["op11_merkle"](spark, table(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, found), key=str) == whole(rows)
    assert n < 700 or 50 < sum(not r.verified for r in found) < 200


def test_empty_table(spark, tmp_path):
    assert QUERIES["op11_merkle"](spark, table(spark, tmp_path, [])).collect() == []


@pytest.mark.parametrize(("arity", "levels", "n"), [(3, 2, 100), (16, 1, 257), (2, 3, 8)])
def test_other_arities_and_some_requests(spark, arity, levels, n):
    rows = [(i, "s", "en" if i % 4 else "de", i, f"t{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.manifest(df, F.col("lang"), F.col("doc_id"), merkle.leaf_digest(*[F.col(c) for c in df.columns]), None, arity, levels)
    got = {r.id: (r.id, r.leaf, r.subroot, r.root, r.proof) for r in merkle.proofs(m, m.leaves.where("id % 3 = 0"), arity, levels).collect()}
    want = {r[0]: r[:5] for r in whole(rows, arity) if r[0] % 3 == 0}
    assert got == want and all(r.folded_root == r.root for r in merkle.proofs(m, m.leaves, arity, levels).collect())


def test_ranks_of_one_large_group_of_ties(spark):
    df = spark.range(5000).select(F.lit("t").alias("tree"), F.lit(1).alias("id"), F.lit(b"d").alias("digest"), "id").toDF("tree", "k", "digest", "own").repartition(7)
    ranked = merkle.ranked(df, ["k", "digest"], "ties")
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(5000)) and ranked.select("n").distinct().collect()[0].n == 5000
