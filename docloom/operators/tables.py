"""Typing of cell grids: spans, headers, column types, units, totals, chartability (F4).

A grid is rows (table_id, row, col, row_span, col_span, text). Everything stays long; nothing is pivoted before the edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import quantity
from .windows import folded

MOST_HEADER_ROWS = 3


def expanded(cells: DataFrame) -> DataFrame:
    """SC-71: a cell for every row and column that it spans; where two overlap the first wins."""
    rows = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r")
    wide = cells.select("table_id", "row", "col", "col_span", "text", rows).select("table_id", "row", "col", "text", "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("c"))
    w = Window.partitionBy("table_id", "r", "c").orderBy("row", "col")
    return wide.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("table_id", F.col("r").alias("row"), F.col("c").alias("col"), "text")


def parsed(cells: DataFrame) -> DataFrame:
    """Cells with the status, value, kind and decimals of their text; a year alone is no number of its own kind."""
    q = quantity(F.col("text"))
    return cells.select("*", q.alias("q")).select(*cells.columns, F.col("q.status").alias("status"), F.col("q.value").alias("value"), F.col("q.kind").alias("kind"), F.col("q.decimals").alias("decimals"), F.trim("text").rlike(r"^(?:19|20)\d\d$").alias("bare_year"), F.col("text").rlike(r"(?i)^\s*(?:[1-4]q|h[12])?\s*fy\s*'?\d{2,4}\s*$").alias("period"))


def header_rows(p: DataFrame) -> DataFrame:
    """SC-72: rows above the first one with a number that is no year, at most three."""
    first = p.groupBy("table_id").agg(F.min(F.when((F.col("status") == "number") & ~F.col("bare_year"), F.col("row"))).alias("first"))
    return first.select("table_id", F.least(F.coalesce("first", F.lit(1)), F.lit(MOST_HEADER_ROWS)).cast("int").alias("header_rows"))


def column_types(p: DataFrame, headers: DataFrame) -> DataFrame:
    """SC-73: the type of each column below the header by the share of its cells."""
    body = p.join(headers, "table_id").where(F.col("row") >= F.col("header_rows"))
    n = lambda c: F.count_if(c)
    number, text = F.col("status") == "number", (F.col("status") == "text")
    g = body.groupBy("table_id", "col").agg(n(number).alias("numbers"), n(text & ~F.col("period")).alias("texts"), n(F.col("period")).alias("periods"), n(F.col("bare_year")).alias("years"), n(number & (F.col("kind") == "percent")).alias("percents"), F.count(F.lit(1)).alias("cells"))
    kind = (
        F.when(F.col("numbers") + F.col("texts") + F.col("periods") == 0, "empty").when((F.col("numbers") > 0) & (F.col("years") == F.col("numbers")) & (F.col("texts") == 0), "year")
        .when(F.col("numbers") * 5 >= (F.col("numbers") + F.col("texts") + F.col("periods")) * 3, F.when(F.col("percents") == F.col("numbers"), "percent").otherwise("number")).when(F.col("periods") * 2 >= F.col("cells"), "period").otherwise("text")
    )
    return g.select("table_id", "col", "numbers", "texts", "periods", kind.alias("type"))


def majority(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """AG-24, AG-26: the commonest value (ties to the first seen), and whether 60 % agree."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_first"))
    w = Window.partitionBy(*keys)
    r = c.withColumn("total", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "_first"))).where("_r = 1")
    return r.select(*keys, value, "n", "total", (F.col("n") * 5 >= F.col("total") * 3).alias("quorum"))


def unanimous(value: Column) -> Column:
    """AG-25: the one value that all have, else null."""
    return F.when(F.count_distinct(value) == 1, F.max(value))


def _totals(state, row):
    """AG-27 for one column: a row that is the sum of the rows above it since the last total."""
    if row is None:
        return state, []
    parts, total = state
    n, s = len(parts), sum(parts)
    tolerance = min(0.5 * 10.0 ** -row.decimals * max(n, 1), 0.002 * abs(row.value)) + 1e-9
    hit = n >= 2 and abs(s - row.value) <= tolerance
    return (([], total + 1) if hit else ([*parts, row.value], total)), [(row.table_id, row.col, row.row, hit, n if hit else 0)]


def totals(numbers: DataFrame) -> DataFrame:
    """AG-27: whether each number of a column is the total of those above it, and of how many."""
    keyed = numbers.select(F.concat_ws("/", F.col("table_id").cast("string"), F.col("col").cast("string")).alias("key"), "table_id", "col", "row", "value", "decimals")
    return folded(keyed, "key", ["row"], _totals, lambda: ([], 0), "table_id long, col int, row int, is_total boolean, parts long")


def chartability(t: DataFrame) -> DataFrame:
    """AG-33: kind and confidence of the best chart from counts of a table: periods, categories, numbers, negatives."""
    n = F.col("periods")
    series = F.when(n >= 4, F.least(F.lit(0.95), 0.85 + 0.02 * (n - 4))).when(n == 3, 0.75).when(n == 2, 0.5).otherwise(0.0)
    categorical = F.when(F.col("categories") >= 2, F.least(F.lit(0.8), 0.6 + 0.05 * (F.col("categories") - 2))).otherwise(0.0)
    composition = F.when((F.col("negatives") == 0) & F.col("categories").between(2, 8), F.greatest(F.lit(0.65), 0.88 - 0.05 * F.greatest(F.col("number_columns") - 1, F.lit(0)))).otherwise(0.0)
    options = F.array(*[F.struct((-c).alias("c"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, c) in enumerate((("time_series", series), ("composition", composition), ("categorical", categorical)))])
    ranked = F.array_sort(F.filter(options, lambda o: o["c"] < 0))
    return t.select("table_id", F.coalesce(F.get(ranked, F.lit(0))["k"], F.lit("table")).alias("best"), F.round(-F.coalesce(F.get(ranked, F.lit(0))["c"], F.lit(0.0)), 4).alias("confidence"), F.array_join(F.transform(ranked, lambda o: o["k"]), ",").alias("options"))


def continuations(t: DataFrame, group: str, keys: str, periods: str, id_col: str = "table_id") -> DataFrame:
    """JN-25: tables of a document with the same columns and no period in common.

    Tables with like columns and periods form a class; only classes are compared, and the pairs of those that fit become pairs of tables, all of which are results.
    """
    a = t.select(group, id_col, F.array_sort(keys).alias("_k"), F.array_sort(periods).alias("_p"))
    one = a.select(group, "_k", "_p").distinct()
    fit = one.join(one.withColumnRenamed("_p", "_q"), [group, "_k"]).where(~F.arrays_overlap("_p", "_q"))
    other = a.select(group, "_k", F.col("_p").alias("_q"), F.col(id_col).alias("other_id"))
    return a.join(fit, [group, "_k", "_p"]).join(other, [group, "_k", "_q"]).where(F.col(id_col) < F.col("other_id")).select(group, id_col, "other_id")


def coverage(old: Column, new: Column) -> Column:
    """JN-27, SE-03, SE-06: how a set of data points relates to an older one."""
    more, less = F.size(F.array_except(new, old)), F.size(F.array_except(old, new))
    return F.when((more == 0) & (less == 0), "same").when(more == 0, "covered").when(less == 0, "extends").otherwise("other")


# Labels of total rows, and units whose amounts add up (none: a plain number).
TOTAL_LABEL = r"(?iu)^(?:total|grand\s+total|sub-?total|net\s+total|कुल|योग)(?![\p{L}\p{N}_])"
ADDITIVE = ("currency", "count", "none")


def _agreeing(total: dict, parts: list[tuple[str, dict]]) -> int | None:
    """In how many additive columns a row is the sum of the parts that have numbers there, two at least; None if any disagrees."""
    checked = 0
    for col, (value, decimals, unit) in total.items():
        present = [cells[col] for _, cells in parts if col in cells]
        if unit.split(":")[0] not in ADDITIVE or len(present) < 2:
            continue
        if any(u != unit for _, _, u in present):
            return None
        most = max([decimals, *(d for _, d, _ in present)])
        # Printed figures are rounded: half a unit for each part, but never more than 0.2 % of the total.
        if abs(sum(v for v, _, _ in present) - value) > min(0.5 * 10.0**-most * len(present), 0.002 * abs(value)) + 1e-9:
            return None
        checked += 1
    return checked


def _nested(state, row):
    """AG-27: state is the rows that nothing has added up yet, totals among them in place of their parts."""
    if row is None or row.section:
        return state, [] if row is None else [(row.table_id, row.row, row.key, False, 0, [])]
    cells = {c["col"]: (c["value"], c["decimals"], c["unit"]) for c in row.values}
    for k in range(2, len(state) + 1):
        checked = _agreeing(cells, state[-k:])
        if checked and (row.labelled or checked >= 2 or k >= 3):
            return [*state[:-k], (row.key, cells)], [(row.table_id, row.row, row.key, True, checked, [key for key, _ in state[-k:]])]
    return [*state, (row.key, cells)], [(row.table_id, row.row, row.key, False, 0, [])]


def nested_totals(rows: DataFrame) -> DataFrame:
    """AG-27: table_id, row, key, is_total, columns (that agree), parts: rows that are the sum of those just above them, over whole rows.

    rows: table_id, row, key, label, section (boolean), values: array<struct<col int, value double, decimals int, unit string>> of the cells that are numbers. A
    total takes the place of its parts, so that a grand total is found as the sum of its subtotals. Every additive column in which the row and two parts
    have numbers must agree, and the row needs a label of a total, two such columns, or three parts; of several runs the shortest counts. Units
    begin with their kind. A table's rows are read in order and only those that nothing has added up are held; a table without rows gives none.
    """
    values = F.filter(F.coalesce("values", F.array().cast("array<struct<col:int,value:double,decimals:int,unit:string>>")), lambda v: v["value"].isNotNull())
    keyed = rows.select("table_id", "row", "key", F.coalesce("section", F.lit(False)).alias("section"), F.coalesce(F.col("label").rlike(TOTAL_LABEL), F.lit(False)).alias("labelled"), values.alias("values"))
    return folded(keyed, "table_id", ["row"], _nested, list, "table_id long, row int, key string, is_total boolean, columns int, parts array<string>")
