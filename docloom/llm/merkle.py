"""Merkle manifest of a table, and proofs by descent of its content-addressed graph.

Rows become leaves (SHA-256 of their fields). Each tree's leaves are ordered and every `arity` consecutive nodes become the hash of their hex
digests, level by level, until one node, the tree's root, remains; the roots, ordered by the trees' names, are the leaves of one tree more, whose
root stands for the table. A level by itself would be a shuffle, so LEVELS of them are a segment: the nodes under one segment root meet in one
group of at most arity ** LEVELS, and the segment is stored as its root's digest with the records digest -> children of all nodes below.

A request names a leaf by tree and rank. All requests descend together from the root: at each segment they look its records up by digest, the digits
of their rank choose a child at each level, and the children not chosen are collected. Requests that share the upper part of their path share one row
there, so above the leaves there is a row for each segment, not for each request. At the leaves the path's segments are reversed into the proof,
and folding a claimed leaf up the same way gives the root that it implies.

Ranks need no window over a tree: leaves are dealt by ranges, stored, and the sizes of the ranges before shift the numbers of each.

Defined cases: a null field is `-`; leaves of null trees form a tree of their own, first in order; a null id sorts first; rows that repeat an id
are leaves each, ordered by leaf digest; equal digests share their records; a tree of one leaf is that leaf; a table without rows has no root and
no proofs; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

ARITY, LEVELS = 2, 6
#: Rows of an Arrow batch that is handed back to Spark.
OUT_ROWS = 512
STORE = "tree string, rank long, n long, digest binary, levels int, records array<struct<digest:binary,children:array<binary>>>"
PATH = "array<struct<digit:int,others:array<binary>>>"
BELOW = f"tree string, rank long, digest binary, path {PATH}, subroot binary, root binary"
PROOFS = "tree string, rank long, id long, leaf string, subroot string, root string, proof string, folded_root string"


class Manifest(NamedTuple):
    """leaves: tree, rank, id, leaf, claim. trees: tree, n, subroot. stores, top: segments of the trees and of their roots, lowest first. root: None if no row."""

    leaves: DataFrame
    trees: DataFrame
    stores: list[DataFrame]
    top: list[DataFrame]
    root: bytes | None


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Binary SHA-256 of the values' fields end to end."""
    return F.unhex(F.sha2(F.concat(*map(field, values)).cast("binary"), 256))


def combined(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(n: int, arity: int) -> int:
    up = 0
    while n > 1:
        n, up = -(-n // arity), up + 1
    return up


def climbed(nodes: list[bytes], levels: int, arity: int) -> tuple[bytes, list[tuple[bytes, list[bytes]]]]:
    """The digest above `nodes` and the records of all nodes that lead there."""
    records = {}
    for _ in range(levels):
        groups = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        nodes = [combined(g) for g in groups]
        records.update(zip(nodes, groups, strict=True))
    return nodes[0], list(records.items())


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some = []
    for r in rows:
        some.append(r)
        if len(some) == OUT_ROWS:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    yield pa.RecordBatch.from_pylist(some, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(0, batch.num_rows, OUT_ROWS):
            yield from batch.slice(i, OUT_ROWS).to_pylist()


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _climber(arity: int, levels: int):
    schema = _arrow(STORE)

    def run(batches):
        def rows():
            for r in _rows(batches):
                up = min(levels, height(r["n"], arity))
                digest, records = climbed([x["digest"] for x in r["nodes"]], up, arity)
                yield {"tree": r["tree"], "rank": r["block"], "n": -(-r["n"] // arity**levels), "digest": digest, "levels": up, "records": [{"digest": d, "children": c} for d, c in records]}

        return _batches(rows(), schema)

    return run


def ranked(nodes: DataFrame, order: list[str], tag: str) -> DataFrame:
    """nodes with rank (from 0, within tree, by order) and n (nodes of the tree). Rows that tie are dealt apart by their place in the input."""
    by = ["tree", *order, "_row"]
    dealt = nodes.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    t = materialize(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), tag)
    runs = t.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("tree", "_part", "_first", before.alias("_before"), F.sum("_n").over(Window.partitionBy("tree")).alias("n")), f"{tag}-runs")
    return t.join(runs, ["tree", "_part"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def climb(nodes: DataFrame, tag: str, arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """Segments, lowest first, over nodes (tree, rank, n, digest); a tree's root is where n is 1."""
    stores, rows, span = [], nodes, arity**levels
    while True:
        block = F.expr(f"rank div {span}").alias("block")
        grouped = rows.groupBy("tree", block, "n").agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("nodes"))
        made = materialize(grouped.mapInArrow(_climber(arity, levels), STORE), f"{tag}-{len(stores)}")
        stores.append(made)
        rows = made.where("n > 1").select("tree", "rank", "n", "digest")
        if rows.isEmpty():
            return stores


def roots(stores: list[DataFrame]) -> DataFrame:
    """tree, digest, stage: each tree's root and the store it is in."""
    found = [s.where("n = 1").select("tree", "digest", F.lit(i).alias("stage")) for i, s in enumerate(stores)]
    for other in found[1:]:
        found[0] = found[0].unionByName(other)
    return found[0]


def manifest(rows: DataFrame, tree: Column, identity: Column, leaf: Column, claim: Column | None = None, arity: int = ARITY, levels: int = LEVELS) -> Manifest:
    """The manifest of rows. leaf, claim: binary digests; a claim is what someone says the row's leaf is (null: what it is)."""
    name = F.coalesce(F.concat(F.lit("+"), tree.cast("string")), F.lit(""))
    nodes = rows.select(name.alias("tree"), identity.cast("long").alias("id"), leaf.alias("digest"), (F.lit(None).cast("binary") if claim is None else claim).alias("claim"))
    leaves = materialize(ranked(nodes, ["id", "digest"], "merkle-dealt"), "merkle-leaves")
    stores = climb(leaves, "merkle-trees", arity, levels)
    trees = materialize(ranked(roots(stores).select("tree", F.col("digest").alias("subroot"), F.col("tree").alias("own"), F.col("stage")).withColumn("tree", F.lit("")), ["own"], "merkle-roots"), "merkle-subroots")
    top = climb(trees.select("tree", "rank", "n", F.col("subroot").alias("digest")), "merkle-top", arity, levels)
    root = roots(top).first()
    return Manifest(leaves, trees.select(F.col("own").alias("tree"), "subroot", "stage", "rank"), stores, top, None if root is None else bytes(root.digest))


def walked(root: bytes, records: dict[bytes, list[bytes]], local: int, levels: int, arity: int) -> tuple[bytes, list[dict]]:
    """The digest that `local` leads to below a segment's root, and for each level the digit and the children not chosen."""
    path = []
    for level in range(levels - 1, -1, -1):
        children, digit = records[root], local // arity**level % arity
        path.append({"digit": digit, "others": children[:digit] + children[digit + 1 :]})
        root = children[digit]
    return root, path


def folded(leaf: bytes, path: list[dict]) -> bytes:
    for step in reversed(path):
        leaf = combined([*step["others"][: step["digit"]], leaf, *step["others"][step["digit"] :]])
    return leaf


def proof(path: list[dict]) -> str:
    return hashlib.sha256("".join(d.hex() for step in reversed(path) for d in step["others"]).encode()).hexdigest()


def _descender(arity: int, span: int, finish: bool):
    schema = _arrow(PROOFS if finish else BELOW)

    def run(batches):
        def rows():
            for r in _rows(batches):
                records = {x["digest"]: x["children"] for x in r["records"]}
                for a in r["asked"]:
                    reached, path = walked(r["digest"], records, a["rank"] - r["block"] * span, r["levels"], arity)
                    path = r["path"] + path
                    if finish:
                        hexes = {k: (v or b"").hex() for k, v in (("leaf", reached), ("subroot", r["subroot"]), ("root", r["root"]), ("folded_root", folded(a["claim"] or reached, path)))}
                        yield {"tree": r["tree"], "rank": a["rank"], "id": a["id"], "proof": proof(path)} | hexes
                    else:
                        yield {"tree": r["tree"], "rank": a["rank"], "digest": reached, "path": path, "subroot": r["subroot"], "root": r["root"]}

        return _batches(rows(), schema)

    return run


def descend(stores: list[DataFrame], starts: DataFrame, asked: DataFrame, finish: bool, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Rows of PROOFS (finish) or BELOW for asked (tree, rank, id, claim), each leaf once. starts: tree, stage, digest, path, subroot, root."""
    span, below = arity**levels, None
    for s in range(len(stores) - 1, -1, -1):
        entered = starts.where(F.col("stage") == s).select("tree", F.lit(0).cast("long").alias("block"), "digest", "path", "subroot", "root")
        if below is not None:
            entered = entered.unionByName(below.withColumnRenamed("rank", "block"))
        wanted = asked.select("tree", F.expr(f"rank div {span**s}").alias("rank")).distinct().withColumns({"id": F.lit(None).cast("long"), "claim": F.lit(None).cast("binary")}) if s else asked
        groups = wanted.groupBy("tree", F.expr(f"rank div {span}").alias("block")).agg(F.collect_list(F.struct("rank", "id", "claim")).alias("asked"))
        # A record is found by its digest alone; segments of equal content share one.
        records = stores[s].groupBy("digest").agg(F.first("levels").alias("levels"), F.first("records").alias("records"))
        last = finish and s == 0
        found = entered.join(groups, ["tree", "block"]).join(records, "digest").mapInArrow(_descender(arity, span, last), PROOFS if last else BELOW)
        below = found if s == 0 else materialize(found, f"merkle-path-{s}")
    return below


def proofs(m: Manifest, asked: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """Rows of PROOFS for asked (tree, rank, id, claim): some or all of m.leaves."""
    root = F.lit(m.root).cast("binary")
    none = F.expr(f"CAST(array() AS {PATH.replace(':', ': ')})")
    tops = roots(m.top).select("tree", "stage", "digest", none.alias("path"), F.lit(None).cast("binary").alias("subroot"), root.alias("root"))
    wanted = m.trees.select(F.lit("").alias("tree"), "rank", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim"))
    upper = descend(m.top, tops, wanted, False, arity, levels).select("rank", "path")
    starts = materialize(m.trees.join(upper, "rank").select("tree", "stage", F.col("subroot").alias("digest"), "path", "subroot", root.alias("root")), "merkle-starts")
    return descend(m.stores, starts, asked.select("tree", "rank", "id", "claim"), True, arity, levels)
