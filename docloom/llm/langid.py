"""Language identification by bit-sliced Bloom filters of n-grams.

Learning counts byte 4-grams of letters by language over all learning documents. A gram belongs to a language if its rate there
reaches MIN_RATE and RATIO of its highest rate in any language; rates of a language sum to one, so it has at most 1 / MIN_RATE
grams. The filters of all languages share one array of slots: bit l of a slot is slot of language l's filter, and the AND of a
gram's HASHES slots is the bitmask of all languages that hold the gram. A document's popcount for each language is corrected for
the filter's false positives, (count - n * f) / (1 - f) with f the share of set bits to the power of HASHES, divided by the hit
rate that the language's own text would have, and the largest decides; score is its share of itself and the runner-up.

Defined cases: a text that is null, empty or without a letter is `und` with score 0; a text that hits no filter gets the language
with most learning grams and score 0; ties go to the first language in name order; without any learning row all is `und`; rows are
scored one by one, so repeated rows score alike; long texts are read whole; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PART_ROWS, by_parts, hand_back, materialize, mix64
from .ngrams import letter_bytes, sliced, sums_by

MIN_RATE, RATIO = 1e-5, 0.1
HASHES, SLOTS_A_GRAM = 4, 24
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Grams of a task that are held before they go on to the shuffle.
HELD = 1_000_000
COUNTS = "lang string, gram long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        parts = held[lang]
        if len(parts) > 1:
            codes, counts = np.concatenate([c for c, _ in parts]), np.concatenate([n for _, n in parts])
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            held[lang] = [(codes[first], np.add.reduceat(counts, first))]
        return held[lang][0]

    def out(lang: str) -> pa.RecordBatch:
        codes, counts = merged(lang)
        del held[lang]
        return pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

    for batch in (b.slice(i, 4 * PART_ROWS) for b in batches for i in range(0, b.num_rows, 4 * PART_ROWS)):
        langs = batch.column(1).to_pylist()
        for lang in set(langs):
            texts = [letter_bytes(t.as_py()) for t, x in zip(batch.column(0), langs, strict=True) if x == lang]
            for _, codes, _ in sliced(texts):
                unique, counts = np.unique(codes, return_counts=True)
                held.setdefault(lang, []).append((unique, counts))
                if len(held[lang]) > 16:
                    merged(lang)
        while sum(len(c) for parts in held.values() for c, _ in parts) > HELD:
            yield out(max(held, key=lambda x: sum(len(c) for c, _ in held[x])))
    for lang in list(held):
        yield out(lang)
    hand_back()


@dataclass
class Filters:
    """Bit-sliced filters: slots[plane, slot] holds the bits of languages 64 * plane and up."""

    languages: list[str]
    fallback: int
    slots: np.ndarray
    false_rate: np.ndarray
    own_rate: np.ndarray

    def masks(self, codes: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        last = np.uint64(self.slots.shape[1] - 1)
        h = mix64(codes, 0)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for i in range(HASHES):
            at = (h + step * np.uint64(i) & last).astype(np.int64)
            got = [plane[at] for plane in self.slots]
            out = [a & b for a, b in zip(out, got, strict=True)] if out else got
        return out

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Corrected share of each text's grams that each language holds."""
        found = np.zeros((len(texts), len(self.languages)))
        for first, codes, ends in sliced(texts):
            n = np.maximum(np.diff(np.concatenate([[0], ends])), 1)
            masks = self.masks(codes)
            for k in range(len(self.languages)):
                plane = masks[k // 64]
                count = sums_by(ends, (plane >> plane.dtype.type(k % 64)) & plane.dtype.type(1))
                found[first : first + len(ends), k] = np.maximum(count - n * self.false_rate[k], 0) / (1 - self.false_rate[k]) / n / self.own_rate[k]
        return found


def fit(docs: DataFrame, min_rate: float = MIN_RATE, ratio: float = RATIO) -> Filters:
    """Learn from every row of docs (text, lang) with both set; choose the learning rows beforehand.

    The driver receives one row for each gram that some language holds, at most languages / MIN_RATE, and the gram total of each language.
    """
    counts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(_count, COUNTS)
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "langid-counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Filters([], 0, np.zeros((1, 1), np.uint8), np.zeros(0), np.zeros(0))
    total = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(float(totals[k])))])[F.col("lang")]
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])[F.col("lang")]
    rates = counts.select(number.alias("k"), "gram", (F.col("n") / total).alias("rate"))
    kept = rates.where(F.col("rate") >= min_rate).groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("k", "rate")).alias("held"))
    kept = kept.select("gram", F.explode(F.filter("held", lambda x: x["rate"] >= F.col("top") * ratio)).alias("x")).select("gram", "x.k", "x.rate").toArrow()
    codes, k, rate = (np.asarray(kept.column(c).combine_chunks()) for c in ("gram", "k", "rate"))
    n_slots = 1 << max(10, int(np.ceil(np.log2(SLOTS_A_GRAM * max(1, np.bincount(k, minlength=1).max(initial=1))))))
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= np.iinfo(t).bits or t is np.uint64)
    slots = np.zeros((-(-len(languages) // 64), n_slots), kind)
    h = mix64(codes, 0)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        at = (h + step * np.uint64(i) & np.uint64(n_slots - 1)).astype(np.int64)
        for j in range(len(languages)):
            own = at[k == j]
            slots[j // 64, own] |= kind(1 << (j % 64))
    filled = np.array([np.mean(slots[j // 64] >> kind(j % 64) & kind(1)) for j in range(len(languages))])
    own_rate = np.maximum(np.bincount(k, rate, minlength=len(languages)), 0.05)
    return Filters(languages, max(range(len(languages)), key=lambda i: totals[languages[i]]), slots, filled**HASHES, own_rate)


def predict(filters: Filters, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, corrected share of the chosen language's grams) of each text."""
    lettered = np.array([bool(t and LETTER.search(t)) for t in texts], dtype=bool)
    if not filters.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    shares = filters.shares([letter_bytes(t) for t in texts])
    best = shares.argmax(axis=1)
    top = shares[np.arange(len(texts)), best]
    second = np.partition(shares, -2, axis=1)[:, -2] if shares.shape[1] > 1 else np.zeros(len(texts))
    best[top <= 0] = filters.fallback
    score = np.where(lettered, np.divide(top, top + second, out=np.zeros(len(texts)), where=top > 0), 0.0)
    return [filters.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)], score, np.where(lettered, np.minimum(top, 1), 0.0)


def language(docs: DataFrame, filters: Filters, text: str = "text") -> Column:
    """struct<lang, score, share> for a text column of docs; the filters go out as one broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(texts: pa.Array) -> pa.Array:
        lang, score, share = predict(shared.value, texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(share)], names=["lang", "score", "share"])

    # Called nondeterministic so that a filter on the result isn't pushed below it as a second evaluation.
    return F.arrow_udf(by_parts(run), "struct<lang:string,score:double,share:double>").asNondeterministic()(F.col(text).cast("string"))
