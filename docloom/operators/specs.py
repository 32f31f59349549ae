"""Chart specs against tables: references resolved to cells, and everything that stands against a spec (JN-23, JN-24, VQ-01, VQ-03's limits).

A spec names no numbers, only references "table:key": series are rows or columns of a table and the x axis is the other of the two. Specs and
tables are frames, and all specs are resolved by the same joins: exploded references meet rows, columns and cells by equality on (table, key), and what
is then gathered for a spec is bounded by the references it may hold. What several steps read is stored in between. Problems are found in steps, as later ones make no sense before earlier ones
are mended; a spec is told all problems of the first step that has any.

Defined cases: a reference without a colon, or with an empty side, is malformed; references that repeat count once; null arrays are empty; a
cell that isn't there leaves its point out; timelines, which show rows and not series, aren't resolved here; a spec of an unknown kind has the limits of none and so no kind problem.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .visual import LIMITS, NO_NEGATIVES, SINGLE_UNIT

# Column types that hold numbers, names of the two axes, and how many tiles a kpi shows.
MEASURED = ["period", "currency", "percent", "ratio", "count", "number"]
ACROSS, DOWN, BY_PERIOD = ["columns", "column_headers"], ["rows", "row_labels"], ["period", "periods"]
MAX_TILES = 6
SPEC = (
    "spec long, kind string, tables array<string>, x string, series array<string>, periods array<string>, categories array<string>, highlight array<string>, "
    "calculations array<struct<op:string,series:string,other:string,from:string,to:string>>"
)


class Tables(NamedTuple):
    """tables: table, period_axis (rows, columns or null), label_key; rewrites read document too. rows: table, key, idx, label, type (data, total, section), period,
    granularity, end, section; rewrites read parts too, the keys that a total adds up.
    columns: table, key, idx, label, type, period, granularity, end, measure. cells: table, row, col, value, unit."""

    tables: DataFrame
    rows: DataFrame
    columns: DataFrame
    cells: DataFrame


def references(specs: DataFrame, name: str) -> DataFrame:
    """spec, pos, ref, table, key of an array of references; a malformed one has no table. The first of those that repeat stays."""
    each = specs.select("spec", F.posexplode(F.array_distinct(F.coalesce(name, F.array().cast("array<string>")))).alias("pos", "ref"))
    colon = F.instr(F.col("ref"), ":")
    table, key = F.when(colon > 1, F.substring_index("ref", ":", 1)), F.expr("substring(ref, instr(ref, ':') + 1)")
    return each.select("spec", "pos", "ref", F.when(key != "", table).alias("table"), F.when(table.isNotNull(), key).alias("key"))


def _problems(rows: DataFrame, step: int, text: Column, order: Column | None = None) -> DataFrame:
    return rows.where(text.isNotNull()).select("spec", F.lit(step).alias("step"), (F.lit(0) if order is None else order).alias("pos"), text.alias("problem"))


def _say(condition: Column, *parts: Column | str) -> Column:
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def axis_of(specs: DataFrame, tables: Tables) -> DataFrame:
    """spec, table, wanted (row, col or null: x names no axis of the spec's tables), for specs that name an x."""
    named = references(specs.where("x IS NOT NULL").withColumn("_x", F.array("x")), "_x").join(specs.select("spec", "tables"), "spec")
    t = tables.tables.select("table", "period_axis", "label_key")
    down = F.col("period_axis").eqNullSafe(F.lit("rows"))
    wanted = (
        F.when(F.col("key").isin(ACROSS), "row").when(F.col("key").isin(DOWN) | F.col("key").eqNullSafe(F.col("label_key")), "col")
        .when(F.col("key").isin(BY_PERIOD), F.when(down, "col").otherwise("row"))
    )
    return named.join(t, "table", "left").select("spec", "table", F.when(F.array_contains("tables", F.col("table")), wanted).alias("wanted"))


def series_of(specs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The series that stand (spec, kind, pos, ref, table, key, axis, picked: the categories of the table, if any), and the problems of the others."""
    chosen = specs.select("spec", "kind", F.col("x").alias("x_ref"), F.array_distinct("tables").alias("members"))
    categories = references(specs, "categories").join(chosen, "spec")
    member = F.coalesce(F.array_contains("members", F.col("table")), F.lit(False))
    told = _problems(categories, 4, F.coalesce(_say(F.col("table").isNull(), "malformed ", F.col("ref")), _say(~member, "category of no table ", F.col("ref"))), F.col("pos"))
    keys = lambda frame, name: frame.select("table", "key", F.lit(True).alias(name))
    picked = categories.where(member).join(keys(tables.rows, "of_row"), ["table", "key"], "left").join(keys(tables.columns, "of_col"), ["table", "key"], "left")
    off = lambda c: F.array_sort(F.collect_set(F.when(F.col(c).isNull(), F.col("ref"))))
    picked = picked.groupBy("spec", "table").agg(F.collect_set("key").alias("picked"), off("of_col").alias("off_row"), off("of_row").alias("off_col"))

    rows = tables.rows.where("type <> 'section'").select("table", "key", F.lit(True).alias("is_row"))
    columns = tables.columns.where(F.col("type").isin(MEASURED)).select("table", "key", F.lit(True).alias("is_col"))
    s = references(specs, "series").join(chosen, "spec").join(rows, ["table", "key"], "left").join(columns, ["table", "key"], "left").na.fill(False, ["is_row", "is_col"])
    s = s.join(tables.tables.select("table", "period_axis"), "table", "left").join(axis_of(specs, tables), ["spec", "table"], "left")
    down = F.col("period_axis").eqNullSafe(F.lit("rows"))
    own = F.when(F.col("is_row") & F.col("is_col"), F.when(down, "col").otherwise("row")).when(F.col("is_row"), "row").when(F.col("is_col"), "col")
    fits = F.when(F.col("wanted") == "row", F.col("is_row")).when(F.col("wanted") == "col", F.col("is_col")).otherwise(own.isNotNull())
    s = s.withColumn("axis", F.when(fits & member, F.coalesce("wanted", own)))
    first = F.first("axis", ignorenulls=True).over(Window.partitionBy("spec", "table").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("first_axis", first).join(picked, ["spec", "table"], "left")
    bad = F.when(F.col("axis") == "row", F.col("off_row")).when(F.col("axis") == "col", F.col("off_col"))
    problem = F.coalesce(
        _say(F.col("table").isNull(), "malformed ", F.col("ref")), _say(~member, "series of no table ", F.col("ref")), _say(F.col("axis").isNull() & F.col("wanted").isNotNull(), "series not on the axis ", F.col("ref")),
        _say(F.col("axis").isNull(), "no row or measured column ", F.col("ref")), _say(F.col("axis") != F.col("first_axis"), "rows and columns mixed ", F.col("table")), _say(F.size(bad) > 0, "categories off the axis ", F.array_join(bad, ", ")),
    )
    s = s.withColumn("problem", problem)
    return s.where("problem IS NULL").select("spec", "kind", "pos", "ref", "table", "key", "axis", "picked"), told.unionByName(_problems(s, 4, F.col("problem"), F.col("pos") + 100))


def shown_rows(rows: DataFrame) -> DataFrame:
    """rows with shown: the label, with its section where another row of the table has the same."""
    same = F.count(F.lit(1)).over(Window.partitionBy("table", "label"))
    label = F.when((same > 1) & (F.col("section") != ""), F.concat("label", F.lit(" ("), F.col("section"), F.lit(")"))).otherwise(F.col("label"))
    return rows.withColumn("shown", F.coalesce(F.nullif(label, F.lit("")), F.col("key")))


def x_items(series: DataFrame, tables: Tables) -> DataFrame:
    """spec, table, axis, x_key, idx, label, period, granularity, end, own_period, total: what each table's series of a spec run over."""
    runs = series.groupBy("spec", "kind", "table", "axis").agg(F.first("picked").alias("picked"))
    part = Window.partitionBy("spec", "table")
    names = ("spec", "table", "axis", "x_key", "idx", "label", "period", "granularity", "end", "own_period", "total")
    chosen = lambda key: F.col("picked").isNull() | F.array_contains("picked", key)
    c = runs.where("axis = 'row'").join(tables.columns.where(F.col("type").isin(MEASURED)), "table").where(chosen(F.col("key")))
    c = c.withColumn("main", F.first("measure", ignorenulls=True).over(part.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    c = c.withColumn("measures", F.size(F.collect_set("measure").over(part))).where(F.col("picked").isNotNull() | (F.col("measures") < 2) | (F.col("measure") == F.col("main")))
    c = c.withColumn("short", F.coalesce("period", "label")).withColumn("full", F.col("label")).withColumns({"x_key": F.col("key"), "own_period": F.col("period"), "total": F.lit(False)})
    is_total = F.col("type") == "total"
    r = runs.where("axis = 'col'").join(shown_rows(tables.rows), "table").where(((F.col("type") == "data") | (is_total & ((F.col("kind") == "table") | F.col("picked").isNotNull()))) & chosen(F.col("key")))
    r = r.withColumn("own_period", F.col("period")).withColumn("period", F.when(~is_total, F.col("period"))).withColumn("short", F.coalesce("period", "shown")).withColumns({"full": F.col("shown"), "x_key": F.col("key"), "total": is_total})
    both = [d.withColumn("label", F.when(F.size(F.collect_set("short").over(part)) < F.count(F.lit(1)).over(part), F.col("full")).otherwise(F.col("short"))).select(*names) for d in (c, r)]
    return both[0].unionByName(both[1])


def points(series: DataFrame, items: DataFrame, cells: DataFrame) -> DataFrame:
    """JN-23: spec, pos, ref, table, label, value, unit: the cells that the series' references stand for; of cells at like labels the last."""
    at = series.select("spec", "pos", "ref", "table", "key", "axis").join(items.select("spec", "table", "x_key", "label", "idx"), ["spec", "table"])
    place = at.select("spec", "pos", "ref", "table", "label", "idx", F.when(F.col("axis") == "row", F.col("key")).otherwise(F.col("x_key")).alias("row"), F.when(F.col("axis") == "row", F.col("x_key")).otherwise(F.col("key")).alias("col"))
    met = place.join(cells, ["table", "row", "col"]).groupBy("spec", "pos", "ref", "table", "label").agg(F.max_by(F.struct("value", "unit"), "idx").alias("cell"))
    return met.select("spec", "pos", "ref", "table", "label", "cell.value", "cell.unit")


def _kept_items(specs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a spec: periodic, and items: the labels that are left after the filters, in order, cut to the kind's most where the spec chose none itself."""
    w = Window.partitionBy("spec")
    one = items.groupBy("spec", "label").agg(
        F.min_by(F.struct("period", "granularity", "end", "own_period", "total"), F.struct("table_pos", "idx")).alias("x"), F.min(F.struct("table_pos", "idx")).alias("place"), F.collect_set(F.concat_ws(":", "table", "x_key")).alias("refs"),
    ).select("spec", "label", "x.*", "place", "refs")
    one = one.withColumn("periodic", F.min(F.col("period").isNotNull()).over(w)).join(specs.select("spec", "kind", F.coalesce("periods", F.array().cast("array<string>")).alias("wanted"), F.array_distinct(F.coalesce("categories", F.array().cast("array<string>"))).alias("order")), "spec")
    explicit, asked, table = (F.size("wanted") > 0) | (F.size("order") > 0), F.size("wanted") > 0, F.col("kind") == "table"
    n = F.count(F.lit(1)).over(Window.partitionBy("spec", "granularity"))
    one = one.withColumn("of_kind", n).withColumn("first_of_kind", F.min("place").over(Window.partitionBy("spec", "granularity")))
    main = F.first("granularity").over(w.orderBy(F.desc("of_kind"), "first_of_kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    dated = F.max(F.col("own_period").isNotNull()).over(w)
    one = one.withColumn("main", main).withColumn("dated", dated)
    stays = (
        F.when(asked & F.col("periodic"), F.array_contains("wanted", F.col("period"))).when(asked & table & F.col("dated"), F.coalesce(F.array_contains("wanted", F.col("own_period")), F.lit(False)))
        .when(F.col("periodic") & ~explicit & ~table, F.col("granularity") == F.col("main")).otherwise(True)
    )
    picked = F.array_min(F.filter(F.transform("order", lambda c, i: F.when(F.array_contains("refs", c), i)), lambda i: i.isNotNull()))
    key = F.when(F.col("periodic"), F.struct(F.coalesce(F.unix_date("end"), F.lit(-(10**6))).alias("a"), F.col("place.table_pos").alias("b"), F.col("place.idx").alias("c"))).otherwise(
        F.struct(F.when(F.size("order") > 0, F.coalesce(picked, F.lit(10**6))).otherwise(0).alias("a"), F.col("place.table_pos").alias("b"), F.col("place.idx").alias("c")))
    found = one.where(stays).groupBy("spec").agg(F.first("periodic").alias("periodic"), F.first(explicit).alias("explicit"), F.array_sort(F.collect_list(F.struct(key.alias("key"), "label", "refs"))).alias("items"))
    return found


def _merged(series: DataFrame) -> DataFrame:
    """JN-24: one row a spec; series of another table that have the same label and unit, and no point in common, become one."""
    one = F.struct("pos", "ref", "table", "label", "unit", "mixed", "xs", "negatives", "numbers")
    listed = series.groupBy("spec").agg(F.array_sort(F.collect_list(one)).alias("given"))
    first = lambda s: F.struct(s["label"].alias("label"), s["unit"].alias("unit"), s["table"].alias("table"), s["xs"].alias("xs"), F.array(s["ref"]).alias("refs"), s["negatives"].alias("negatives"), s["numbers"].alias("numbers"))
    none = F.array().cast("array<struct<label:string,unit:string,table:string,xs:array<string>,refs:array<string>,negatives:boolean,numbers:boolean>>")

    def add(acc: Column, s: Column) -> Column:
        fits = lambda a: (a["label"] == s["label"]) & a["unit"].eqNullSafe(s["unit"]) & ~F.arrays_overlap(a["xs"], s["xs"]) & (a["table"] != s["table"])
        at = F.array_position(F.transform(acc, fits), F.lit(True)) - 1
        joined = lambda a, i: F.when(i == at, F.struct(a["label"].alias("label"), a["unit"].alias("unit"), a["table"].alias("table"), F.concat(a["xs"], s["xs"]).alias("xs"), F.array_append(a["refs"], s["ref"]).alias("refs"), (a["negatives"] | s["negatives"]).alias("negatives"), (a["numbers"] | s["numbers"]).alias("numbers"))).otherwise(a)
        return F.when(at >= 0, F.transform(acc, joined)).otherwise(F.concat(acc, F.array(first(s))))

    return listed.withColumn("shown", F.aggregate("given", none, add))


def resolved(specs: DataFrame, tables: Tables) -> DataFrame:
    """spec, kind, problems (empty: the spec resolves), x (the labels shown), series (struct<label, unit, refs>)."""
    specs = specs.select(*[x.split()[0] for x in SPEC.replace("struct<op:string,series:string,other:string,from:string,to:string>", "s").split(", ")])
    lists = lambda *names: {n: F.coalesce(n, F.array().cast("array<string>")) for n in names}
    specs = specs.withColumns(lists("tables", "series", "periods", "categories", "highlight"))
    named = specs.select("spec", F.posexplode(F.array_distinct("tables")).alias("table_pos", "table"))
    known = named.join(tables.tables.select("table", F.lit(True).alias("known")), "table", "left")
    told = [_problems(known, 1, _say(F.col("known").isNull(), "unknown table ", F.col("table")), F.col("table_pos"))]
    told.append(_problems(axis_of(specs, tables).join(specs.select("spec", "x"), "spec"), 2, _say(F.col("wanted").isNull(), "x is no axis ", F.col("x"))))
    limits = F.create_map(*[F.lit(v) for k, n in LIMITS.items() for v in (k, n[1])])
    told.append(_problems(specs, 3, _say(F.size("series") == 0, "no series")))
    told.append(_problems(specs, 4, _say((F.size("series") > limits[F.col("kind")]) & (F.col("kind") != "kpi"), "too many series"), F.lit(-1)))
    series, of_series = series_of(specs, tables)
    series, of_series = stored(series, "spec-series"), stored(of_series, "spec-problems")
    told.append(of_series)
    periods = lambda f: f.select("table", "period").where("period IS NOT NULL")
    has = named.join(periods(tables.rows).unionByName(periods(tables.columns)), "table").groupBy("spec").agg(F.collect_set("period").alias("has"))
    asked = specs.select("spec", F.posexplode("periods").alias("pos", "period")).join(has, "spec", "left")
    told.append(_problems(asked, 5, _say(~F.coalesce(F.array_contains("has", F.col("period")), F.lit(False)), "no such period ", F.col("period")), F.col("pos")))

    turns = series.groupBy("spec", "table").agg(F.min("pos").alias("table_pos"))  # items come in the order of the first series of their tables
    items = stored(x_items(series, tables).join(turns, ["spec", "table"]), "spec-items")
    kept = stored(_kept_items(specs, items), "spec-kept")
    told.append(_problems(specs.join(kept, "spec", "left"), 6, _say(F.col("items").isNull(), "no x left")))

    label = F.coalesce(F.nullif(F.col("shown"), F.lit("")), F.col("key"))
    base = shown_rows(tables.rows).select("table", "key", F.lit("row").alias("axis"), label.alias("name")).unionByName(tables.columns.select("table", "key", F.lit("col").alias("axis"), F.coalesce(F.nullif("label", F.lit("")), F.col("key")).alias("name")))
    measured = items.where("axis = 'row'").join(tables.columns.select("table", F.col("key").alias("x_key"), "measure"), ["table", "x_key"]).groupBy("spec", "table").agg(F.min("measure").alias("measure"), F.count_distinct("measure").alias("n"))
    several = tables.columns.where(F.col("type").isin(MEASURED)).groupBy("table").agg(F.count_distinct("measure").alias("measures"))
    named_series = series.join(base, ["table", "key", "axis"]).join(measured, ["spec", "table"], "left").join(several, "table", "left")
    narrowed = (F.col("axis") == "row") & F.col("picked").isNull() & (F.col("measures") > 1)
    named_series = named_series.withColumn("name", F.when(narrowed, F.concat_ws(" · ", "name", "measure")).otherwise(F.col("name"))).select("spec", "pos", "name")
    lo, hi = [F.create_map(*[F.lit(v) for k, n in LIMITS.items() for v in (k, n[i])])[F.col("kind")] for i in (2, 3)]
    cut = lambda n: F.when(F.col("explicit") | (F.size("items") <= n), F.col("items")).when(F.col("periodic"), F.expr("slice(items, -most, most)")).otherwise(F.slice("items", 1, n))
    kept = kept.join(specs.select("spec", "kind"), "spec").withColumn("most", F.coalesce(hi, F.lit(1 << 20))).withColumn("over", F.col("explicit") & (F.size("items") > F.col("most")))
    kept = kept.withColumn("chosen", F.size("items")).withColumn("items", cut(F.col("most"))).withColumn("x", F.transform("items", lambda i: i["label"]))
    p = points(series, items, tables.cells).join(kept.select("spec", "x"), "spec").where(F.array_contains("x", F.col("label")))
    filled = F.col("value").isNotNull()
    each = p.groupBy("spec", "pos").agg(F.min_by("unit", F.array_position("x", F.col("label")) + F.when(filled, 0).otherwise(10**6)).alias("u"), F.count_if(filled).alias("n"), F.count_distinct(F.when(filled, F.coalesce("unit", F.lit("")))).alias("units"), F.collect_set("label").alias("xs"), F.coalesce(F.bool_or(F.col("value") < 0), F.lit(False)).alias("negatives"))
    each = series.select("spec", "pos", "ref", "table").join(named_series, ["spec", "pos"]).join(each, ["spec", "pos"], "left")
    each = each.select("spec", "pos", "ref", "table", F.col("name").alias("label"), F.when(F.col("n") > 0, F.col("u")).alias("unit"), (F.coalesce("units", F.lit(0)) > 1).alias("mixed"), F.coalesce("xs", F.array().cast("array<string>")).alias("xs"), F.coalesce("negatives", F.lit(False)).alias("negatives"), (F.coalesce("n", F.lit(0)) > 0).alias("numbers"))
    each = stored(each, "spec-points")
    whole = kept.join(_merged(each), "spec").join(specs.select("spec", "highlight", "calculations", F.col("series").alias("asked_series")), "spec")
    whole = stored(whole, "spec-whole")
    told.append(_last_problems(whole, lo))

    every = reduce(DataFrame.unionByName, told)
    first = every.withColumn("first", F.min("step").over(Window.partitionBy("spec"))).where("step = first").groupBy("spec").agg(F.array_sort(F.collect_list(F.struct("pos", "problem"))).alias("p"))
    shown = whole.select("spec", "x", F.transform("shown", lambda s: F.struct(s["label"].alias("label"), s["unit"].alias("unit"), s["refs"].alias("refs"))).alias("series"))
    done = specs.select("spec", "kind").join(first, "spec", "left").join(shown, "spec", "left")
    ok = F.col("p").isNull()
    return done.select("spec", "kind", F.coalesce(F.transform("p", lambda x: x["problem"]), F.array().cast("array<string>")).alias("problems"), F.when(ok, F.col("x")).alias("x"), F.when(ok, F.col("series")).alias("series"))


def _last_problems(whole: DataFrame, least_x: Column) -> DataFrame:
    """What only a resolved spec can be told: limits, units, signs, kinds that don't suit, highlights and calculations of things not shown."""
    kind, shown, n = F.col("kind"), F.col("shown"), F.size("x")
    least = F.create_map(*[F.lit(v) for k, limits in LIMITS.items() for v in (k, limits[0])])[kind]
    units = F.array_distinct(F.transform(shown, lambda s: F.coalesce(s["unit"], F.lit("no unit"))))
    refs, xs = F.flatten(F.transform(shown, lambda s: s["refs"])), F.concat(F.col("x"), F.flatten(F.transform("items", lambda i: i["refs"])))
    mixed = F.transform(F.filter("given", lambda s: s["mixed"] & (kind != "table")), lambda s: F.concat(F.lit("mixed units "), s["ref"]))
    calculation = lambda c: F.array_compact(F.concat(F.array(F.coalesce(
        _say(~F.array_contains(refs, c["series"]), "calculation of no series ", c["series"]), _say(c["other"].isNotNull() & ~F.array_contains(refs, c["other"]), "calculation of no series ", c["other"]),
        _say((c["op"] == "ratio") & c["other"].isNull(), "ratio of nothing"))),
        F.when(F.array_contains(refs, c["series"]) & (c["other"].isNull() | F.array_contains(refs, c["other"])) & ((c["op"] != "ratio") | c["other"].isNotNull()), F.array(
            _say(c["from"].isNotNull() & ~F.array_contains(xs, c["from"]), "calculation at no x ", c["from"]), _say(c["to"].isNotNull() & ~F.array_contains(xs, c["to"]), "calculation at no x ", c["to"]))).otherwise(F.array().cast("array<string>"))))
    calculations = F.flatten(F.transform(F.coalesce("calculations", F.array().cast(SPEC.split("calculations ")[1])), calculation))
    highlights = F.transform(F.filter("highlight", lambda h: ~F.array_contains(F.concat(xs, refs), h)), lambda h: F.concat(F.lit("highlight of nothing shown "), h))
    found = F.concat(
        F.array(_say(F.col("over"), "too many x"), _say(n < least_x, "too few x")), mixed,
        F.array(
            _say(~F.exists(shown, lambda s: s["numbers"]), "no numbers"), _say(F.size(shown) < least, "too few series"), _say(kind.isin(SINGLE_UNIT) & (F.size(units) > 1), "more than one unit ", F.array_join(F.array_sort(units), ", ")),
            _say(kind.isin(NO_NEGATIVES) & F.exists(shown, lambda s: s["negatives"]), "negative values"), _say(kind.isin(NO_NEGATIVES) & F.array_contains(units, "ratio"), "ratios don't add"),
            _say((kind == "donut") & F.col("periodic"), "a donut over periods"), _say((kind == "line") & ~F.col("periodic"), "a line without periods"),
            _say((kind == "comparison") & (n == 1) & (F.size(shown) < 2), "nothing to compare"), _say((kind == "kpi") & (F.size("asked_series") > MAX_TILES), "too many tiles"),
        ), highlights, calculations,
    )
    return whole.select("spec", F.posexplode(F.array_compact(found)).alias("pos", "problem")).select("spec", F.lit(7).alias("step"), "pos", "problem")
