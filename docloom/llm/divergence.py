"""Source divergence audit: which sources of a language differ in their words, and in which words.

A term is a run of letters (ASCII letters in lower case, and all characters beyond ASCII). A language keeps the terms that occur in at least
MIN_DOCS of its documents. Most distinct terms don't, so they are found by iceberg prefix refinement: a scan counts the documents of each byte prefix of
a first length, prefixes under the threshold are discarded, and the next scan counts only prefixes that extend those left, twice as long, until no
prefix that is left can be extended. A prefix shorter than its level's length is a complete term, so its count is the term's own. Counts are
partial within a task, then summed by a shuffle on (lang, prefix), of which there is one row a task. What is left of a level goes to the next scan as a
bitmap of hashes of fixed size: a false hit costs a count that the threshold then drops, so results stay exact at any size.

Shares are integers of a billion: p = 1 + floor(10^9 (count + 5) / (N + 5 V)). Sums of |p - q| over all kept terms for each pair of sources
are made from dense tiles: TILE sources by CHUNK terms, so that neither a language with most rows nor one with many sources meets in one task.

Defined cases: null text, lang and source count as empty; a source without terms is a group like any other; a language that keeps no term has
pairs of value 0; a source alone in its language has no pairs; repeated rows are documents each; ties rank by the item's bytes; extra columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hand_back, materialize, slices

MIN_DOCS, FIRST_LENGTH, TOP = 30, 4, 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Bits of the map of what a level keeps, bytes of text looked at together, sources and terms of a tile.
MAP_BITS, SLICE_BYTES, TILE, CHUNK = 25, 4 << 20, 128, 2048
#: Bytes outside terms become spaces, capital letters small ones.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Words(NamedTuple):
    """terms: the distinct ones; code: of each word in turn; doc: the word's document within the slice."""

    terms: pa.Array
    code: np.ndarray
    doc: np.ndarray


def words(texts: list[bytes]) -> Words:
    raw = np.frombuffer(b" ".join([b"", *texts, b""]).translate(TERMS), np.uint8)
    inside = raw != 32
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, sizes = change[::2], change[1::2] - change[::2]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])]).dictionary_encode()
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    return Words(found.dictionary, np.asarray(found.indices).astype(np.int64), np.searchsorted(starts, first, "right") - 1)


def slots(parts: list[bytes], lang: str) -> np.ndarray:
    """A bit of the map for each prefix or term of a language."""
    seed, h = zlib.crc32(lang.encode()), xxhash.xxh3_64_intdigest
    return np.fromiter((h(x, seed) for x in parts), np.uint64, len(parts)) >> np.uint64(64 - MAP_BITS)


def marked(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def prefix_counts(w: Words, lang: str, length: int, before: int, bitmap: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """Prefixes of `length` bytes and the documents of the slice that hold each. before: the last level's length, whose kept prefixes bitmap marks."""
    sizes = np.asarray(pc.binary_length(w.terms))
    go_on = np.flatnonzero(sizes >= before)
    if bitmap is not None and len(go_on):
        heads = pc.binary_slice(w.terms.take(pa.array(go_on)), 0, before).dictionary_encode()
        go_on = go_on[marked(bitmap, slots(heads.dictionary.to_pylist(), lang))[np.asarray(heads.indices)]]
    prefixes = pc.binary_slice(w.terms.take(pa.array(go_on)), 0, length).dictionary_encode()
    of_term = np.full(len(w.terms), -1, np.int64)
    of_term[go_on] = np.asarray(prefixes.indices)
    own, n = of_term[w.code], len(prefixes.dictionary)
    met = pc.unique(pa.array((w.doc * n + own)[own >= 0])).to_numpy()
    return prefixes.dictionary, np.bincount(met % n, minlength=n) if n else np.zeros(0, np.int64)


def _sliced(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple[str, ...], Words]]:
    """Words of a few megabytes of documents with equal keys. Columns: the keys, then the text."""
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
        order = sorted(range(batch.num_rows), key=keys.__getitem__)
        sizes = pc.binary_length(batch.column(n_keys)).to_pylist()
        starts = [i for i, k in enumerate(order) if i == 0 or keys[k] != keys[order[i - 1]]]
        for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
            for i, j in slices([sizes[k] for k in order[a:b]], SLICE_BYTES):
                texts = batch.column(n_keys).take(pa.array(order[a + i : a + j])).cast(pa.large_binary())
                yield keys[order[a]], words(texts.to_pylist())


def _level(length: int, before: int, bitmap: Broadcast | None):
    def run(batches):
        for (lang,), w in _sliced(batches, 1):
            prefixes, n = prefix_counts(w, lang, length, before, bitmap and bitmap.value)
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), prefixes.cast(pa.binary()), pa.array(n, pa.int64())], names=["lang", "prefix", "n"])
        hand_back()

    return run


def _occurrences(bitmap: Broadcast):
    def run(batches):
        for (lang, source), w in _sliced(batches, 2):
            kept = np.flatnonzero(marked(bitmap.value, slots(w.terms.to_pylist(), lang)))
            n = np.bincount(w.code, minlength=len(w.terms))[kept]
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), w.terms.take(pa.array(kept)).cast(pa.binary()), pa.array(n, pa.int64())], names=["lang", "source", "term", "n"])
        hand_back()

    return run


def _bits(batches):
    for batch in batches:
        rows = pd.DataFrame({"lang": batch.column(0).to_pylist(), "prefix": batch.column(1).to_pylist()})
        at = np.concatenate([np.zeros(0, np.uint64), *(slots(x["prefix"].tolist(), lang) for lang, x in rows.groupby("lang"))])
        yield pa.record_batch([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])


def bitmap_of(kept: DataFrame) -> Broadcast:
    """A broadcast of 1 << MAP_BITS bits, those of kept (lang, prefix) set."""
    rows = kept.select("lang", "prefix").mapInArrow(_bits, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    found[np.asarray(rows.column(0))] = np.asarray(rows.column(1)).astype(np.int64).view(np.uint64)
    return kept.sparkSession.sparkContext.broadcast(found)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, first_length: int = FIRST_LENGTH) -> DataFrame:
    """lang, prefix (a whole term, as bytes), n: its documents. docs: lang, source, text, none null."""
    length, before, bitmap, found = first_length, 0, None, None
    while True:
        counted = docs.select("lang", "text").mapInArrow(_level(length, before, bitmap), "lang string, prefix binary, n long")
        level = materialize(counted.groupBy("lang", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs), f"prefixes-{length}")
        size = F.octet_length("prefix")
        whole, open_ = level.where(size < length), level.where(size == length)
        found = whole if found is None else found.unionByName(whole)
        if bitmap is not None:
            bitmap.unpersist()
        if open_.isEmpty():
            return found
        bitmap, before, length = bitmap_of(open_), length, 2 * length


def share(n, total, kept):
    """1 + floor(SCALE (n + SMOOTH) / (total + SMOOTH kept)), exactly; 0 without kept terms."""
    exact = F.expr(f"CAST({SCALE} AS DECIMAL(10,0)) * CAST({n} + {SMOOTH} AS DECIMAL(19,0)) div CAST({total} + {SMOOTH} * {kept} AS DECIMAL(20,0))")
    return F.when(F.col(kept) > 0, 1 + exact).otherwise(0).cast("long")


def _tile(tile: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Sums of |p - q| for the pairs of one tile. A row without a term gives a source's share where it lacks a term."""
        lang, ti, tj = rows[["lang", "ti", "tj"]].iloc[0]
        absent = rows[rows["term"].isna()].sort_values("place")
        terms = rows[rows["term"].notna()]
        place, row = absent["place"].to_numpy(), pd.factorize(terms["term"])[0]
        n = int(row.max()) + 1 if len(row) else 0
        shares = np.tile(absent["p"].to_numpy(np.int64), (n, 1))
        shares[row, np.searchsorted(place, terms["place"].to_numpy())] = terms["p"].to_numpy(np.int64)
        right, out = np.flatnonzero(place // tile == tj), []
        for a in np.flatnonzero(place // tile == ti):
            other = right[right > a]
            out.append(pd.DataFrame({"a": place[a], "b": place[other], "f": np.abs(shares[:, [a]] - shares[:, other]).sum(0)}))
        return pd.concat([*out, pd.DataFrame({"a": [], "b": [], "f": []})]).astype("int64").assign(lang=lang, seen=n)[["lang", "a", "b", "f", "seen"]]

    return run


def pair_values(groups: DataFrame, shares: DataFrame, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """lang, source, item, value for each two sources of a language. groups: lang, source, place, absent, sources, kept; shares: lang, place, term, p."""
    tiles = F.ceil(F.col("sources") / tile)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("kept") / chunk))
    both = lambda rows: rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1))).withColumn("own", F.floor(F.col("place") / tile)).select("lang", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "chunk", "place", "term", "p")
    lacking = both(groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))).withColumn("term", F.lit(None).cast("binary")).withColumn("p", F.col("absent")))
    having = both(shares.withColumn("chunk", F.pmod(F.xxhash64("term"), chunks)))
    sums = lacking.unionByName(having).groupBy("lang", "ti", "tj", "chunk").applyInPandas(_tile(tile), "lang string, a long, b long, f long, seen long").groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("seen").alias("seen"))
    side = lambda x: groups.select("lang", F.col("place").alias(x), F.col("source").alias(f"source_{x}"), F.col("absent").alias(f"absent_{x}"), *(["kept"] if x == "a" else []))
    value = F.col("f") + (F.col("kept") - F.col("seen")) * F.abs(F.col("absent_a") - F.col("absent_b"))
    found = sums.join(side("a"), ["lang", "a"]).join(side("b"), ["lang", "b"]).withColumn("value", value)
    turned = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    return found.select("lang", F.explode(turned).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, first_length: int = FIRST_LENGTH, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """lang, source, part, item, value, rank, see the module and the query's contract."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = materialize(kept_terms(docs, min_docs, first_length).select("lang", "prefix"), "divergence-terms")
    bitmap = bitmap_of(kept)
    met = docs.mapInArrow(_occurrences(bitmap), "lang string, source string, term binary, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    counts = materialize(met.join(kept.withColumnRenamed("prefix", "term"), ["lang", "term"]), "divergence-counts")
    bitmap.unpersist()

    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "kept"])
    groups = groups.withColumn("place", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")).withColumn("sources", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    groups = materialize(groups.withColumn("none", F.lit(0)).withColumn("absent", share("none", "total", "kept")).drop("none"), "divergence-groups")
    shares = materialize(counts.join(groups.select("lang", "source", "place", "total", "kept", "sources"), ["lang", "source"]).withColumn("p", share("n", "total", "kept")).select("lang", "source", "place", "sources", "kept", "term", "n", "p"), "divergence-shares")

    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    usual = shares.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(langs, "lang").withColumn("q", share("n", "total", "kept")).select("lang", "term", "q")
    over = shares.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranks = lambda rows, part: rows.withColumn("rank", F.row_number().over(by)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranks(pair_values(groups, shares, tile, chunk), "pair").unionByName(ranks(over, "term").where(F.col("rank") <= top))
