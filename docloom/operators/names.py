"""Names as heard: words within an edit or two of exactly one word of a lexicon (JN-21, SC-25), and key points that say the same (AG-35)."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import folded

# Letters that are taken for each other at the start of a word, least letters of a lexicon word and of an unfamiliar one, letters from which two edits are allowed.
ONSETS = ("vwb", "zsjx", "ckq", "fp", "td", "ae", "iey", "ou")
LEXICON_LETTERS, UNFAMILIAR_LETTERS, TWO_EDITS_FROM = 5, 8, 7
SAME_POINT, MOST_POINTS = 0.75, 8
#: Words of more letters are no names: they are left as they are, which bounds what a word is exploded to.
MOST_LETTERS = 40


def aligned_distance(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours, no letter edited twice (optimal string alignment)."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, row = row, now
    return row[-1]


def distance(a: Column, b: Column) -> Column:
    """SC-25."""

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else aligned_distance(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return F.arrow_udf(run, "int")(a, b)


def shortened(word: Column, edits: Column) -> Column:
    """The word without up to `edits` (1 or 2) of its letters, each form once. Words within that many edits of each other have a form in common."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substring(w, i + 1, F.length(w))))
    one = less(word)
    both = F.concat(F.array(word), one, F.flatten(F.transform(one, less)))
    return F.array_distinct(F.when(edits > 1, both).otherwise(F.concat(F.array(word), one)))


def same_onset(a: Column, b: Column) -> Column:
    x, y = F.left(a, F.lit(1)), F.left(b, F.lit(1))
    shared = [x.isin(*g) & y.isin(*g) for g in ONSETS]
    out = x == y
    for s in shared:
        out = out | s
    return out


def corrections(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, target, edits for each word (lower case) that is closest to exactly one word of the lexicon and isn't in it.

    words, lexicon: a column word each. A lexicon word of seven letters or more may be two edits away, shorter ones one, and the first letters must be the
    same or confusable. Both sides are indexed by their shortened forms and meet there by equality, so no word is compared with all of the lexicon. Nulls and
    words of over MOST_LETTERS take no part; repeated words count once.
    """
    fits = (F.length("word") > 1) & (F.length("word") <= MOST_LETTERS)
    known = lexicon.select("word").where(fits).distinct()
    edits = F.when(F.length("word") >= TWO_EDITS_FROM, 2).otherwise(1)
    index = known.select(F.col("word").alias("target"), F.explode(shortened(F.col("word"), edits)).alias("form"))
    asked = words.select("word").where(fits).distinct().join(known, "word", "left_anti")
    asked = asked.select("word", F.explode(shortened(F.col("word"), F.when(F.length("word") >= TWO_EDITS_FROM - 2, 2).otherwise(1))).alias("form"))
    met = asked.join(index, "form").select("word", "target").distinct()
    limit = F.when(F.length("target") >= TWO_EDITS_FROM, 2).otherwise(1)
    near = met.where((F.abs(F.length("word") - F.length("target")) <= limit) & same_onset(F.col("word"), F.col("target")))
    near = near.withColumn("edits", distance(F.col("word"), F.col("target"))).where(F.col("edits") <= limit)
    best = near.groupBy("word").agg(F.min(F.struct("edits", "target")).alias("b"), F.min("edits").alias("edits"))
    ties = near.join(best.select("word", "edits"), ["word", "edits"]).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return best.join(ties.where("n = 1"), "word").select("word", "b.target", "edits")


def latin_words(text: Column) -> Column:
    """Runs of ASCII letters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?<![A-Za-z])[A-Za-z]+(?![A-Za-z])"), F.lit(0))


def heard_names(text: Column) -> Column:
    """Words that may be misheard names: title case, and long enough to be unfamiliar."""
    return F.filter(latin_words(text), lambda w: w.rlike("^[A-Z][a-z]+$") & (F.length(w) >= UNFAMILIAR_LETTERS))


def own_words(labels: DataFrame, group: str, words: str) -> DataFrame:
    """SE-04: labels with own (their words less those that every label of the group has) and shared (these), both in order.

    The intersection of a group's labels is what as many of them hold as there are, so words are counted and no group is collected. words: an array without
    repeats; a label without words empties the intersection of its group; a null group is one of its own.
    """
    sizes = labels.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    held = labels.select(group, F.explode(words).alias("_word")).groupBy(group, "_word").agg(F.count(F.lit(1)).alias("_k"))
    same = lambda a, b: a[group].eqNullSafe(b[group])
    every = held.join(sizes, same(held, sizes)).where("_k = _n").groupBy(held[group].alias("_group")).agg(F.array_sort(F.collect_list("_word")).alias("shared"))
    joined = labels.join(every, labels[group].eqNullSafe(every["_group"]), "left").drop("_group").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))
    return joined.withColumn("own", F.array_sort(F.array_except(F.coalesce(words, F.array().cast("array<string>")), F.col("shared"))))


_POINT_WORD = re.compile(r"[\wऀ-ॿ%.,₹]+")


def point_words(text: str) -> frozenset[str]:
    return frozenset(w.strip(".,").casefold() for w in _POINT_WORD.findall(text) if w.strip(".,"))


def same_point(a: frozenset[str], b: frozenset[str]) -> bool:
    """One's words are all in the other, or three quarters of the words of both are."""
    return bool(a and b) and (a <= b or b <= a or len(a & b) >= SAME_POINT * len(a | b))


def merged_points(points: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """AG-35: key, place (from 0), text, sources: points in order, each joined to the first kept one that says the same, whose sources it adds to.

    points: key, pos, text, sources (array<long>). Once `most` points are kept a key is done, and later ones change nothing. The result depends on the
    order, so a key's points are folded one by one; only the kept ones are held. Null and blank texts are no points; null sources are none.
    """

    def step(state, row):
        if row is None:
            return state, [(state["key"], i, text, sources) for i, (text, _, sources) in enumerate(state["kept"])]
        state["key"], kept = row.key, state["kept"]
        if len(kept) < most:
            own, sources = point_words(row.text), [int(s) for s in row.sources]
            first = next((p for p in kept if same_point(p[1], own)), None)
            if first is None:
                kept.append((row.text, own, list(dict.fromkeys(sources))))
            else:
                first[2].extend(s for s in dict.fromkeys(sources) if s not in first[2])
        return state, []

    given = points.select("key", "pos", F.trim("text").alias("text"), F.coalesce("sources", F.array().cast("array<long>")).alias("sources")).where("text <> ''")
    return folded(given, "key", ["pos"], step, lambda: {"key": None, "kept": []}, "key long, place int, text string, sources array<long>")
