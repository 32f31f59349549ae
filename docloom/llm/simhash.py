"""Near-duplicate classes by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints of equal value collapse to one row first. Distinct fingerprints are dealt to groups that agree on one of
MAX_BITS + 1 blocks of bits, since any two that differ in at most MAX_BITS bits agree on at least one block; a group larger than
GROUP_ROWS is dealt again by blocks of its remaining bits until none is, so no task meets an unbounded group and no link is
lost. Within a group the fingerprints are sorted by Gray rank, runs of FANOUT form nodes, and runs of nodes form upper nodes. A
node holds the bits that all below it share, less those its parent already holds; a search walks down adding up the differences
to those bits and drops a node, with all below it, once they pass MAX_BITS. Each task unites what it links and emits a spanning
forest, never all pairs; alternating star contraction over those edges gives the classes.

Defined cases: a text that is null, empty or white space has fingerprint zero, which links like any other; fewer words than a
shingle form one; repeated rows share a class; a null doc_id takes part but never names a class (a class of null ids alone is
null); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_parts, discard, encoded, hand_back, materialize

WORDS, SEED, MAX_BITS, BITS = 3, 42, 3, 64
FANOUT, GROUP_ROWS = 8, 8192
#: Rows of whole groups, and pairs of a query and an item, that a task holds at once.
HELD_ROWS, HELD_PAIRS = 200_000, 4_000_000
#: Shingle hashes turned into bit counts at once.
HASHES_AT_ONCE = 1 << 16
NO_ID = (1 << 63) - 1


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """The hash of each shingle, repeats included."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), HASHES_AT_ONCE):
        counts += np.unpackbits(h[i : i + HASHES_AT_ONCE].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    return majority(shingle_hashes(text, words))


def fingerprint_of(text: Column, words: int = WORDS) -> Column:
    """The fingerprint as a long with the same bits."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, words) for t in encoded(texts)], np.uint64).view(np.int64))

    return F.arrow_udf(by_parts(run), "long")(text.cast("string"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def sub_masks(fixed: int, blocks: int) -> list[int]:
    """The free bits of a mask, cut into so many blocks of neighbours."""
    free = [b for b in range(BITS) if not fixed >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(free, blocks) if len(part)]


class GrayIndex:
    """Hierarchical index over the fingerprints of some groups, each under a root of its own."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), group))
        self.group, self.codes = group[order], codes[order]
        n = len(codes)
        start = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))
        sizes = np.diff(np.append(start, n))
        self.size = np.repeat(sizes, sizes)
        self.root = np.repeat(np.arange(len(start)), sizes)
        both, either, last = self.codes, self.codes, np.arange(n) + 1
        self.levels: list[tuple[np.ndarray, ...]] = []  # from the leaves up: shared bits, their values, first and past-the-last child, past-the-last row
        while True:
            count = -(-sizes // FANOUT)
            lead = np.concatenate([np.arange(c) * FANOUT for c in count]) if len(count) < 64 else _runs(count) * FANOUT
            first = np.repeat(start, count) + lead
            stop = np.minimum(first + FANOUT, np.repeat(start + sizes, count))
            both, either = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(either, first)
            last = last[stop - 1]
            self.levels.append((~(both ^ either), both, first, stop, last))
            sizes, start = count, np.cumsum(count) - count
            if (sizes == 1).all():
                break

    def links(self, max_bits: int, held: int = HELD_PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows (in index order, first below second) that differ in at most max_bits bits, by slices of queries."""
        load = np.cumsum(self.size)
        at = 0
        while at < len(self.codes):
            stop = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + held, side="right")))
            yield self._search(np.arange(at, stop), max_bits)
            at = stop

    def _search(self, query: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        node, parent_bits = self.root[query], np.zeros(len(query), np.uint64)
        differ = np.zeros(len(query), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            shared, value, first, stop, last = self.levels[level]
            differ = differ + np.bitwise_count((self.codes[query] ^ value[node]) & shared[node] & ~parent_bits)
            keep = (differ <= max_bits) & (last[node] > query + 1)
            query, node, differ = query[keep], node[keep], differ[keep]
            children = stop[node] - first[node]
            parent_bits = np.repeat(shared[node], children)
            below = np.repeat(first[node], children) + _runs(children)
            query, differ, node = np.repeat(query, children), np.repeat(differ, children), below
        near = differ + np.bitwise_count((self.codes[query] ^ self.codes[node]) & ~parent_bits) <= max_bits
        near &= node > query
        return query[near], node[near]


def _runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, … up to each count, end to end."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest row of its set) after joining rows a and b pairwise."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped


def forest(group: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, code of its set's first row) that connect what the index links."""
    index = GrayIndex(group, codes)
    labels = np.arange(len(codes))
    for a, b in index.links(max_bits):
        labels = unite(labels, a, b)
    moved = np.flatnonzero(labels != np.arange(len(codes)))
    return index.codes[moved], index.codes[labels[moved]]


def _linker(max_bits: int, held_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, codes = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(n: int) -> pa.RecordBatch:
            u, v = forest(groups[:n], codes[:n], max_bits)
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            groups = np.concatenate([groups, np.asarray(batch.column(0))])
            codes = np.concatenate([codes, np.asarray(batch.column(1)).view(np.uint64)])
            if len(groups) >= held_rows:
                n = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
                if n:
                    yield edges(n)
                    groups, codes = groups[n:], codes[n:]
        if len(groups):
            yield edges(len(groups))
        hand_back()

    return run


def dealt(codes: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> list[DataFrame]:
    """Tables (grp, fp) of groups of at most group_rows, such that near fingerprints share a group in one of them."""
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m

    def deal(rows: DataFrame, masks: list[int]) -> DataFrame:
        table = F.create_map(*[x for m in masks for x in (F.lit(signed(m)).cast("long"), F.array(*[F.lit(signed(s)).cast("long") for s in sub_masks(m, max_bits + 1)]))])
        rows = rows.select("fp", "fixed", "grp", F.explode(F.element_at(table, F.col("fixed"))).alias("block"))
        return rows.select("fp", F.col("fixed").bitwiseOR(F.col("block")).alias("fixed"), F.xxhash64("grp", "block", F.col("fp").bitwiseAND(F.col("block"))).alias("grp"))

    masks, out = [0], []
    rows = codes.select("fp", F.lit(0).cast("long").alias("fixed"), F.lit(0).cast("long").alias("grp"))
    while True:
        rows = materialize(deal(rows, masks), "simhash-groups")
        large = materialize(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("grp"), "simhash-large")
        if large.isEmpty():
            return [*out, rows.select("grp", "fp")]
        out.append(rows.join(large, "grp", "left_anti").select("grp", "fp"))
        rows = rows.join(large, "grp", "left_semi")
        masks = sorted({m | s for m in masks for s in sub_masks(m, max_bits + 1)})


def near_edges(codes: DataFrame, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS, held_rows: int = HELD_ROWS) -> DataFrame:
    """u, v: edges of fingerprints whose connected parts are those of all links."""
    parts = [t.repartition("grp").sortWithinPartitions("grp").mapInArrow(_linker(max_bits, held_rows), "u long, v long") for t in dealt(codes, max_bits, group_rows)]
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return edges


def connected(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge that isn't the smallest of its part: large-star and small-star in turn until nothing moves."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
        if not found.n or state == tuple(found):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(found)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        last, now = now, materialize(small.where("u <> v").distinct(), "components")
        discard(last)


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach."""
    prints = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_of(F.col("text"), words).alias("fp")), "simhash-prints")
    codes = materialize(prints.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("first")), "simhash-codes")
    roots = connected(near_edges(codes.select("fp"), max_bits, group_rows))
    rooted = codes.join(roots, codes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labelled = rooted.join(classes, "root").select("fp", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))
    return prints.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
