"""SimHash near-duplicates at a stated similarity: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.

Fingerprints that differ in few bits find the closest copies only, so the Gray-order index of `simhash` over five-word fingerprints proposes
the first links, and an exact completion finds the rest. Texts with equal sets collapse to one row first. Two sets that similar share a member
of their prefixes, the n - ceil(0.8 n) + 1
first of n shingles in any order that holds for all, so rows that meet at a prefix shingle are all there is to compare and no link
is lost. The order puts shingles that are frequent in a sample last, which keeps common lines out of most prefixes; it changes
the cost only. Of the rows at a shingle, each is compared with the one that shares most; only rows still in different classes
are then compared pair by pair, where sizes and positions allow 0.8 and their prefixes share as much as such sets must. Every link, those of the index too, is confirmed on the whole sets, which are
computed for the texts of proposed pairs alone.

Defined cases: a null, empty or white-space text has no shingles and links to its like only; fewer words than a shingle form one;
repeated rows share a class; a null doc_id takes part but never names a class (a class of null ids alone is null); other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_parts, discard, encoded, materialize
from .simhash import MAX_BITS, SEED, connected, majority, near_edges, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Documents sampled for frequent shingles, how many of these a shingle must be in, and the most shingles kept.
SAMPLED, FREQUENT, KEPT = 5_000, 4, 50_000
EDGE = 1e-9


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes, ascending."""
    return np.unique(shingle_hashes(text, words))


def prefix(found: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The shingles of which a similar set has one at least among its own, rarest first."""
    n = len(found)
    if not n:
        return found
    at = np.minimum(np.searchsorted(frequent, found), max(len(frequent) - 1, 0))
    often = np.where(frequent[at] == found, counts[at], 0) if len(frequent) else np.zeros(n, np.int64)
    return found[np.lexsort((found, often))][: n - math.ceil(similarity * n - EDGE) + 1]


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _keys(rows: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([_key(x) for x in rows], np.uint64).view(np.int64))


def sets_of(text: Column, words: int) -> Column:
    """struct<key, hashes> of the whole set."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [shingles(t, words) for t in encoded(texts)]
        return pa.StructArray.from_arrays([_keys(rows), _lists(rows)], names=["key", "hashes"])

    return F.arrow_udf(by_parts(run), "struct<key:long,hashes:array<long>>")(text.cast("string"))


def prefixes_of(text: Column, shared, words: int, similarity: float) -> Column:
    """struct<key, fp, size, prefix>; shared: a broadcast of frequent shingles and their counts; fp: the fingerprint."""

    def run(texts: pa.Array) -> pa.Array:
        hashes = [shingle_hashes(t, words) for t in encoded(texts)]
        prints = pa.array(np.array([majority(x) for x in hashes], np.uint64).view(np.int64))
        rows = [np.unique(x) for x in hashes]
        sizes = pa.array([len(x) for x in rows], pa.int32())
        return pa.StructArray.from_arrays([_keys(rows), prints, sizes, _lists([prefix(x, *shared.value, similarity) for x in rows])], names=["key", "fp", "size", "prefix"])

    return F.arrow_udf(by_parts(run), "struct<key:long,fp:long,size:int,prefix:array<long>>")(text.cast("string"))


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes that are frequent in a sample of documents, with their counts there."""
    every = max(1, docs.count() // SAMPLED)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select(sets_of(F.col("text"), words).alias("s")).select(F.explode("s.hashes").alias("h"))
    rows = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(KEPT).toArrow()
    hashes, counts = np.asarray(rows.column(0)).astype(np.int64).view(np.uint64), np.asarray(rows.column(1)).astype(np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def needed(n: Column, m: Column, similarity: float) -> Column:
    """How many members the prefixes of two sets of n and m have in common at least, if the sets are similar.

    Such sets share `both`; the prefix that ends first in the order lies in the other's wherever the sets meet, and misses at most what its own set does.
    """
    both = F.ceil(similarity / (1 + similarity) * (n + m) - EDGE)
    of = lambda x: both - F.ceil(similarity * x - EDGE) + 1
    return F.least(of(n), of(m))


def promising(pairs: DataFrame, shared: DataFrame, similarity: float) -> DataFrame:
    """u, v: the pairs whose prefixes share enough. A prefix meets its pairs as one list, so that a pair is one row throughout."""
    keys = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    lists = materialize(shared.join(keys, "key", "left_semi").groupBy("key").agg(F.first("size").alias("size"), F.collect_list("h").alias("prefix")), "copies-prefixes")
    side = lambda k, n: lists.select(F.col("key").alias(k), F.col("size").alias(n), F.col("prefix").alias(f"of_{k}"))
    met = pairs.join(side("u", "n"), "u").join(side("v", "m"), "v")
    return met.where(F.size(F.array_intersect("of_u", "of_v")) >= needed(F.col("n"), F.col("m"), similarity)).select("u", "v")


def confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v: the pairs of keys whose whole sets are similar; sets names one text (th) of each key."""
    keys = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    wanted = materialize(sets.select("key", "th").join(keys, "key", "left_semi").select("th"), "copies-wanted")
    texts = docs.withColumn("th", F.xxhash64("text")).join(wanted, "th", "left_semi").groupBy("th").agg(F.first("text").alias("text"))
    members = materialize(texts.select(sets_of(F.col("text"), words).alias("s")).select("s.key", "s.hashes"), "copies-members")
    side = lambda n: members.select(F.col("key").alias(n), F.col("hashes").alias(f"of_{n}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    both = both.select("u", "v", F.size("of_u").alias("n"), F.size("of_v").alias("m"), F.size(F.array_intersect("of_u", "of_v")).alias("common"))
    found = materialize(both.where(F.col("common") >= similarity * (F.col("n") + F.col("m") - F.col("common")) - EDGE).select("u", "v"), "copies-links")
    discard(wanted, members)
    return found


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def indexed(sets: DataFrame, max_bits: int) -> DataFrame:
    """key, size, o_key, o_size: pairs that the Gray-order index links, each set with the first of its fingerprint and those along its forest."""
    lead = materialize(sets.groupBy("fp").agg(F.min(F.struct("key", "size")).alias("lead")), "copies-codes")
    own = sets.join(lead, "fp").where(F.col("key") != F.col("lead.key")).select("key", "size", F.col("lead.key").alias("o_key"), F.col("lead.size").alias("o_size"))
    one = lambda n, p: lead.select(F.col("fp").alias(n), F.col("lead.key").alias(f"{p}key"), F.col("lead.size").alias(f"{p}size"))
    near = near_edges(lead.select("fp"), max_bits).join(one("u", ""), "u").join(one("v", "o_"), "v")
    return own.unionByName(near.select("key", "size", "o_key", "o_size"))


def links(docs: DataFrame, sets: DataFrame, words: int, similarity: float, max_bits: int) -> DataFrame:
    """u, v: edges between keys of sets (key, fp, size, prefix, th: a hash of one text) whose connected parts are those of all links."""
    near_size = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - EDGE
    met = materialize(sets.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("met")).where("met > 1"), "copies-met")
    shared = materialize(sets.select("key", "size", F.posexplode("prefix").alias("pos", "h")).join(met, "h"), "copies-shared")
    degrees = materialize(shared.groupBy("key").agg(F.sum("met").alias("degree")), "copies-degrees")
    leads = shared.join(degrees, "key").groupBy("h").agg(F.max(F.struct("degree", "key", "size")).alias("lead"))
    led = shared.select("key", "size", "h").join(leads, "h").select("key", "size", F.col("lead.key").alias("o_key"), F.col("lead.size").alias("o_size"))
    proposed = indexed(sets, max_bits).unionByName(led).where((F.col("key") != F.col("o_key")) & near_size(F.col("size"), F.col("o_size")))
    tried = materialize(proposed.select(*_ordered(F.col("key"), F.col("o_key"))).distinct(), "copies-tried")
    likely = materialize(promising(tried, shared, similarity), "copies-likely")
    first = confirmed(likely, docs, sets, words, similarity)
    roots = connected(first)

    now = shared.drop("met").join(roots, F.col("key") == F.col("node"), "left").select("h", "key", "size", "pos", F.coalesce("root", "key").alias("root"))
    split = now.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("h")
    now = materialize(now.join(split, "h", "left_semi"), "copies-left")
    other = now.select("h", *[F.col(c).alias(f"o_{c}") for c in ("key", "size", "pos", "root")])
    # At the first shingle that two ordered sets share, all other common ones come after it in both, and so do all that their prefixes must share.
    room = F.least(F.col("size") - F.col("pos"), F.col("o_size") - F.col("o_pos")) >= similarity / (1 + similarity) * (F.col("size") + F.col("o_size")) - EDGE
    left = lambda n, pos: n - F.ceil(similarity * n - EDGE) + 1 - pos
    ahead = F.least(left(F.col("size"), F.col("pos")), left(F.col("o_size"), F.col("o_pos"))) >= needed(F.col("size"), F.col("o_size"), similarity)
    pairs = now.join(other, "h").where((F.col("key") < F.col("o_key")) & (F.col("root") != F.col("o_root")) & near_size(F.col("size"), F.col("o_size")) & room & ahead)
    met_first = materialize(pairs.select(F.col("key").alias("u"), F.col("o_key").alias("v")).distinct().join(tried, ["u", "v"], "left_anti"), "copies-pairs")
    rest = materialize(promising(met_first, now, similarity), "copies-rest")
    found = materialize(first.unionByName(confirmed(rest, docs, sets, words, similarity)), "copies-edges")
    discard(met, shared, degrees, tried, likely, now, met_first, rest)
    return found


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, th (xxhash64 of the text), class, component_id: the smallest doc_id that links reach."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, words))
    found = docs.select("doc_id", F.xxhash64("text").alias("th"), prefixes_of(F.col("text"), shared, words, similarity).alias("s"))
    prints = materialize(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "th", "s.*"), "copies-prints")
    # Of equal sets one row goes on; the others are listed, so that where they are few no prefix is shuffled.
    firsts = materialize(prints.groupBy("key").agg(F.min("row").alias("row"), F.min("doc_id").alias("first")), "copies-firsts")
    again = materialize(prints.select("row").join(firsts, "row", "left_anti"), "copies-again")
    sets = prints.join(again, "row", "left_anti").select("key", "fp", "size", "prefix", "th")
    roots = connected(links(docs, sets, words, similarity, max_bits))
    rooted = firsts.join(roots, firsts.key == roots.node, "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "th", "key").join(rooted.join(classes, "root").select("key", F.col("root").alias("class"), "component_id"), "key").select("doc_id", "th", "class", "component_id")
