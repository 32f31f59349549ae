"""Parsed items, short texts and remaining orderings: headings, tables as Markdown, labels, vocabularies, evidence, catalog steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Units, cue words for better directions, router phrases.
UNIT_WORDS = {"crore": "crore", "lakh": "lakh", "million": "million", "billion": "billion", "percent": "percent", "%": "percent"}
DOWN_IS_GOOD = r"(?i)\b(?:cost|expense|debt|loss|churn|npa|delay)"
UP_IS_GOOD = r"(?i)\b(?:revenue|profit|margin|sales|growth|income)"
PHRASES = {"stop": ["stop", "cancel", "enough"], "thanks": ["thanks", "thank you"], "greeting": ["hello", "hi", "namaste"]}


def heading_path(level: Column, text: Column, keys: list[str], order: list[str], levels: int = 3) -> Column:
    """SRC-04: the headings above an item; a shallower heading clears the deeper ones."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct(*order)
    parts = []
    for n in range(1, levels + 1):
        own = F.last(F.when(level == n, F.struct(place.alias("p"), text.alias("t"))), ignorenulls=True).over(w)
        cleared = F.last(F.when(level < n, place), ignorenulls=True).over(w)
        parts.append(F.when(own.isNotNull() & (cleared.isNull() | (own["p"] > cleared)), own["t"]))
    return F.array_compact(F.array(*parts))


def markdown(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """SRC-05: a table's cells by row and column as Markdown lines."""
    rows = cells.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("col", "text"))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["text"]), " | "), F.lit(" |"))
    return rows.select(key, "row", line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("l")).select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))


def footnote_split(text: Column) -> tuple[Column, Column]:
    """SC-05: the text without its closing mark, and the mark."""
    mark = F.regexp_extract(text, r"([¹²³*†‡]|\[\d+\])$", 1)
    return F.regexp_replace(text, r"\s*(?:[¹²³*†‡]|\[\d+\])$", ""), F.nullif(mark, F.lit(""))


def within_tokens(text: Column, budget: int) -> Column:
    """SC-11: the longest start of a text within a token budget, in closed form for one script."""
    return F.left(text, F.lit(int(budget * 3.5)))


def unit_of(text: Column) -> Column:
    """SC-51: the unit that a caption names; percent before scales, the first in this order."""
    low = F.lower(text)
    return F.when(low.rlike(r"%|\bper ?cent\b"), "percent").when(low.rlike(r"\bcrores?\b|\bcr\b"), "crore").when(low.rlike(r"\blakhs?\b"), "lakh").when(low.rlike(r"\bmillions?\b|\bmn\b"), "million").when(low.rlike(r"\bbillions?\b|\bbn\b"), "billion")


def better_direction(metric: Column) -> Column:
    """SC-60."""
    return F.when(metric.rlike(DOWN_IS_GOOD), "down").when(metric.rlike(UP_IS_GOOD), "up")


def routed(text: Column) -> Column:
    """SC-38: the phrase set that a normalised utterance belongs to."""
    t = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    out = F.lit(None).cast("string")
    for name, phrases in reversed(PHRASES.items()):
        out = F.when(t.isin(phrases), name).otherwise(out)
    return out


def answer_language(asked: Column, spoken: Column, majority: Column) -> Column:
    """SC-15: asked for, else spoken, else the majority, else English."""
    return F.coalesce(asked, spoken, majority, F.lit("en"))


def unsupported(answer: Column, allowed: Column) -> Column:
    """SC-36: figures of an answer that no source has; years and whole numbers under ten don't count. Commas and trailing zeros are ignored."""
    key = lambda n: F.regexp_replace(F.regexp_replace(n, ",", ""), r"(\.\d*?)0+$|\.$", "$1")
    figures = F.transform(F.regexp_extract_all(answer, F.lit(r"(?<![\d.])(\d[\d,]*(?:\.\d+)?)"), F.lit(1)), key)
    counted = F.filter(figures, lambda n: ~n.rlike(r"^(?:19|20)\d\d$") & ~n.rlike(r"^\d$"))
    return F.array_except(F.array_distinct(counted), F.transform(allowed, key))


def denial(text: Column) -> Column:
    """FLT-16: the first clause says that the sources don't cover it."""
    return F.get(F.split(F.lower(text), r"[.;,]"), F.lit(0)).rlike(r"\b(?:not|no)\b.*\b(?:covered|found|mention|available|information)")


def labels_unique(df: DataFrame, label: str, keys: list[str], order: list[str]) -> DataFrame:
    """SC-78: a second like label gets a number; every row gets an alias D1, D2, …"""
    w = Window.partitionBy(*keys)
    n = F.row_number().over(Window.partitionBy(*keys, label).orderBy(*order))
    return df.withColumn("shown", F.when(n == 1, F.col(label)).otherwise(F.concat(F.col(label), F.lit(" ("), n.cast("string"), F.lit(")")))).withColumn("alias", F.concat(F.lit("D"), F.row_number().over(w.orderBy(*order)).cast("string")))


def neighbours(text: Column, is_table: Column, keys: list[str], order: list[str], reach: int = 6, most: int = 2) -> Column:
    """SC-77: up to two paragraphs before an item within six items, none beyond another table."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-reach, -1)
    seen = F.collect_list(F.struct(is_table.alias("t"), text.alias("x"))).over(w)
    back = F.reverse(seen)
    stop = F.coalesce(F.nullif(F.array_position(F.transform(back, lambda i: i["t"]), F.lit(True)), F.lit(0)) - 1, F.size(back)).cast("int")
    return F.reverse(F.transform(F.slice(F.slice(back, F.lit(1), stop), F.lit(1), F.lit(most)), lambda i: i["x"]))


def candidates_scored(df: DataFrame) -> DataFrame:
    """SO-10: overlap + 2 x title hits + 1.5 x fitting shapes + 3 if retrieved + 6 if of the source document + confidence, then the lower page."""
    s = F.round(F.col("overlap") + 2 * F.col("title_hits") + 1.5 * F.col("shapes") + 3 * F.col("retrieved").cast("int") + 6 * F.col("of_source").cast("int") + F.col("confidence"), 4)
    return df.withColumn("score", s)


def period_order() -> list[Column]:
    """SO-12, WN-26: by end, the longer period first."""
    return [F.col("end"), F.desc("months")]


def vocabulary(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """SC-29: terms of each group, in most rows first, rarer overall first among equals."""
    t = df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.col(text), r"[^\p{L}]+"), lambda x: F.length(x) >= 4))).alias("term"))
    own = t.groupBy(key, "term").agg(F.count(F.lit(1)).alias("rows"))
    total = t.groupBy("term").agg(F.count(F.lit(1)).alias("everywhere"))
    return own.join(total, "term").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rows"), "everywhere", "term"))).where(F.col("rank") <= most)


def with_job(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """DM-02: a document, its first version and a queued job, as three frames of one commit."""
    return documents, documents.select(F.col("id").alias("document_id"), F.lit(1).alias("version")), documents.select(F.col("id").alias("document_id"), F.lit("QUEUED").alias("state"))


def events_in_order(df: DataFrame, key: str, date: str, printed: str) -> DataFrame:
    """SO-13: place of each event: by date if all dates of a key are ISO, else in the printed order."""
    iso = F.bool_and(F.col(date).rlike(r"^\d{4}-\d{2}-\d{2}$")).over(Window.partitionBy(key))
    ordered = df.withColumn("_date", F.when(iso, F.col(date)))
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_date", printed))).drop("_date")


def spec_key(spec: Column) -> Column:
    """SC-75: a flat JSON object with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(spec, "map<string,string>")))))


def overview_rebuilt(old: DataFrame, new: DataFrame, scope: str, order: list[Column]) -> DataFrame:
    """DM-10: the new panels of each scope, in order; one whose spec was there keeps the old id (the first, if there are more), others take fresh_id. What is only old goes."""
    known = old.groupBy(scope, spec_key(F.col("spec")).alias("_key")).agg(F.min("id").alias("_id"))
    joined = new.withColumn("_key", spec_key(F.col("spec"))).join(known, [scope, "_key"], "left")
    place = F.row_number().over(Window.partitionBy(scope).orderBy(*order)) - 1
    return joined.withColumn("position", place.cast("int")).withColumn("id", F.coalesce("_id", "fresh_id")).drop("_key", "_id", "fresh_id")


def ordered_union(first: Column, second: Column) -> Column:
    """SE-05: all of the first, then what the second adds, each once."""
    return F.array_distinct(F.concat(first, second))
