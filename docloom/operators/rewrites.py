"""Rewrites of chart specs that don't resolve (VQ-10): every form of the same choice, tried in order.

The forms of all specs are rows, resolved in one pass, and each spec takes the first of its forms that stands: as given; its rows as categories of
one column (transposed); waterfalls that add up to a checked total (bridges); without highlights and calculations; without filters; kinds it may
fall back to, each with and without filters and transposed; its first series alone. After a form that mixes units comes the same
over the rows in the column's commonest unit. A spec has some twenty forms at most, and as many bridges as its table has totals.

Defined cases: a spec that nothing mends has no form; forms that repeat are tried again and change nothing; ties between units and between
totals go to the first row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .specs import MEASURED, SPEC, Tables, references, resolved
from .visual import FALLBACK

ONE_SERIES = ["donut", "waterfall"]
FIELDS = ("kind", "tables", "x", "series", "periods", "categories", "highlight", "calculations")
_STRINGS = "array<string>"
_FORMS = 1000


def _none(kind: str = _STRINGS) -> Column:
    return F.array().cast(kind)


def _plain() -> dict[str, Column]:
    return {"highlight": _none(), "calculations": _none(SPEC.split("calculations ")[1])}


def one_document(specs: DataFrame, tables: Tables) -> DataFrame:
    """specs cut down to the tables of one document, that of their first series, else of their first table; a spec of which nothing is left is gone."""
    known = tables.tables.select("table", "document")
    named = specs.select("spec", F.posexplode(F.array_distinct("tables")).alias("pos", "table")).join(known, "table")
    asked = references(specs, "series").select("spec", (F.col("pos") - 1000).alias("pos"), "table").join(known, "table")
    lead = named.select("spec", "pos", "table", "document").unionByName(asked.select("spec", "pos", "table", "document")).groupBy("spec").agg(F.min_by("document", "pos").alias("lead"))
    keep = named.join(lead, "spec").groupBy("spec").agg(F.count_distinct("document").alias("n"), F.array_sort(F.collect_list(F.when(F.col("document") == F.col("lead"), F.struct("pos", "table")))).alias("keep"))
    d = specs.join(keep, "spec", "left").withColumn("keep", F.transform("keep", lambda k: k["table"]))
    of = lambda r: F.array_contains(F.col("keep"), F.substring_index(r, ":", 1))
    cut = {
        "series": F.filter("series", of), "tables": F.col("keep"), "categories": F.filter("categories", lambda r: ~F.contains(r, F.lit(":")) | of(r)), "highlight": F.filter("highlight", lambda r: ~F.contains(r, F.lit(":")) | of(r)),
        "calculations": F.filter("calculations", lambda c: F.array_contains(F.filter("series", of), c["series"])),
    }
    several = F.col("n") > 1
    d = d.where(~F.coalesce(several, F.lit(False)) | (F.size(cut["series"]) > 0) | (F.col("kind") == "timeline"))
    return d.select("spec", *[F.when(several, cut[f]).otherwise(F.col(f)).alias(f) if f in cut else F.col(f) for f in FIELDS])


def measure_columns(specs: DataFrame, tables: Tables, table: Column) -> DataFrame:
    """spec, table, column: what a transposed spec runs down: the latest column of the first measure, of those of a period that was asked for if there are any."""
    c = specs.select("spec", table.alias("table"), "periods").join(tables.columns.where(F.col("type").isin(MEASURED)), "table")
    asked, w = F.coalesce(F.array_contains("periods", F.col("period")), F.lit(False)), Window.partitionBy("spec")
    c = c.withColumn("asked", asked).withColumn("any", F.max("asked").over(w)).where("asked OR NOT any")
    first = F.first("measure", ignorenulls=True).over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c = c.withColumn("main", first).where(F.col("main").isNull() | F.col("measure").eqNullSafe(F.col("main")))
    return c.groupBy("spec", "table").agg(F.max_by("key", F.struct(F.coalesce(F.unix_date("end"), F.lit(0)), -F.col("idx"))).alias("column"))


def transposed(specs: DataFrame, tables: Tables) -> DataFrame:
    """The specs whose series, two or more, are rows of one table, with these as categories of one column."""
    rows = tables.rows.where("type <> 'section'").select("table", "key", F.lit(True).alias("is_row"))
    refs = references(specs, "series").join(rows, ["table", "key"], "left")
    one = refs.groupBy("spec").agg(F.count(F.lit(1)).alias("n"), F.count("is_row").alias("rows"), F.count_distinct("table").alias("tables_"), F.min("table").alias("of")).where("n >= 2 AND rows = n AND tables_ = 1 AND of IS NOT NULL")
    d = specs.join(one.select("spec", "of"), "spec")
    d = d.join(measure_columns(d, tables, F.col("of")).select("spec", "column"), "spec")
    changed = {"tables": F.array("of"), "series": F.array(F.concat_ws(":", "of", "column")), "categories": F.array_distinct("series"), "periods": _none(), **_plain()}
    return d.select("spec", *[changed[f].alias(f) if f in changed else F.col(f) for f in FIELDS])


def bridges(specs: DataFrame, flipped: DataFrame, tables: Tables) -> DataFrame:
    """spec, rank and the waterfall of each checked total of the first table with its parts before it, those whose parts were chosen first."""
    w = flipped.where("kind = 'waterfall'")
    w = w.unionByName(specs.where("kind = 'waterfall'").join(w.select("spec"), "spec", "left_anti").select(*w.columns)).withColumn("of", F.get("tables", F.lit(0))).where("of IS NOT NULL")
    own = F.transform(F.filter(F.concat("series", "categories"), lambda r: r.startswith(F.concat("of", F.lit(":")))), lambda r: F.substring(r, F.length("of") + 2, F.length(r)))
    named = references(w, "series").join(tables.columns.where("period IS NOT NULL").select("table", "key"), ["table", "key"]).join(w.select("spec", F.col("of").alias("table")), ["spec", "table"]).groupBy("spec").agg(F.min_by("key", "pos").alias("asked"))
    usual = measure_columns(w, tables, F.col("of")).select("spec", "column")
    w = w.withColumn("chosen", own).join(named, "spec", "left").join(usual, "spec", "left").withColumn("column", F.coalesce("asked", "column")).where("column IS NOT NULL")
    totals = tables.rows.where("type = 'total' AND size(parts) >= 2 AND period IS NULL").select(F.col("table").alias("of"), "key", "idx", "parts")
    d = w.join(totals, "of").withColumn("line", F.array_append("parts", F.col("key")))
    met = F.size(F.array_intersect("chosen", F.array_distinct("line")))
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("spec").orderBy(F.desc(met), "idx")))
    changed = {"tables": F.array("of"), "x": F.lit(None).cast("string"), "series": F.array(F.concat_ws(":", "of", "column")), "categories": F.transform("line", lambda k: F.concat_ws(":", "of", k)), "periods": _none(), **_plain()}
    return d.select("spec", "rank", *[changed[f].alias(f) if f in changed else F.col(f) for f in FIELDS])


def _narrowed(forms: DataFrame, tables: Tables) -> DataFrame:
    """Forms with one series, a column, over the data rows whose cells have the column's commonest unit, if there are two units and two such rows."""
    one = forms.where(F.size("series") == 1)
    keyed = one.withColumnRenamed("spec", "_spec").withColumn("spec", F.col("form"))
    at = references(keyed, "series").select(F.col("spec").alias("form"), "table", F.col("key").alias("col"))
    cells = at.join(tables.cells.where("value IS NOT NULL"), ["table", "col"]).join(tables.rows.where("type = 'data'").select("table", F.col("key").alias("row"), "idx"), ["table", "row"]).withColumn("unit", F.coalesce("unit", F.lit("")))
    units = cells.groupBy("form", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"), F.array_sort(F.collect_list(F.struct("idx", F.concat_ws(":", "table", "row").alias("ref")))).alias("rows"))
    main = units.groupBy("form").agg(F.count(F.lit(1)).alias("units"), F.max_by("rows", F.struct("n", -F.col("first"))).alias("rows")).where("units > 1 AND size(rows) >= 2")
    changed = {"categories": F.transform("rows", lambda r: r["ref"]), "periods": _none()}
    return one.join(main, "form").select("spec", (F.col("form") + 1).alias("form"), "how", *[changed[f].alias(f) if f in changed else F.col(f) for f in FIELDS])


def variants(specs: DataFrame, tables: Tables) -> DataFrame:
    """spec, form (ascending in the order in which forms are tried; odd ones are narrowed and count only after one that mixes units), how, and the form."""
    lists = {f: F.coalesce(f, _none()) for f in ("tables", "series", "periods", "categories", "highlight")}
    specs = specs.select("spec", *FIELDS).withColumns(lists).withColumn("calculations", F.coalesce("calculations", _none(SPEC.split("calculations ")[1])))
    flipped = stored(transposed(specs, tables), "spec-transposed")
    bare, narrow = _plain(), F.col("kind").isin(ONE_SERIES)
    no_filters = {**bare, "periods": _none(), "categories": _none()}

    def form(rows: DataFrame, order: int | Column, how: str, **changed: Column) -> DataFrame:
        return rows.withColumns(changed).select("spec", ((F.lit(order) if isinstance(order, int) else order) * 2).alias("form"), F.lit(how).alias("how"), *FIELDS)

    chain = F.create_map(*[F.lit(v) for kv in FALLBACK.items() for v in kv])
    out = [
        form(specs, 0, "as given"), form(flipped.where(narrow), 1, "transposed"), form(bridges(specs, flipped, tables), F.least(F.col("rank") + 1, F.lit(_FORMS // 4)), "bridge"),
        form(specs, 300, "plain", **bare), form(specs, 301, "no filters", **no_filters), form(flipped.where(~narrow), 302, "transposed"),
    ]
    for step in (1, 2):
        kind = reduce(lambda k, _: chain[k], range(step), F.col("kind"))
        of = lambda rows, kind=kind: rows.where(kind.isNotNull())
        at = 300 + 10 * step
        out += [form(of(specs), at, "other kind", **bare, kind=kind), form(of(specs), at + 1, "other kind, no filters", **no_filters, kind=kind), form(of(flipped), at + 2, "other kind, transposed", kind=kind)]
    out.append(form(specs.where(F.size("series") > 1), 340, "first series", **bare, series=F.slice("series", 1, 1)))
    found = stored(reduce(DataFrame.unionByName, out).withColumn("form", F.col("spec") * _FORMS + F.col("form")), "spec-forms")
    return found.unionByName(_narrowed(found, tables).withColumn("how", F.concat("how", F.lit(", one unit"))))


def first_valid(specs: DataFrame, tables: Tables) -> DataFrame:
    """spec, how (null: nothing resolves), and kind, x and series of the first form that does."""
    forms = stored(variants(specs, tables), "spec-variants")
    r = resolved(forms.withColumn("spec", F.col("form")), tables).select(F.col("spec").alias("form"), "problems", "x", F.col("series").alias("shown"))
    r = stored(forms.select("spec", "form", "how", "kind").join(r, "form"), "spec-tried")
    mixed = r.where(F.exists("problems", lambda p: p.startswith("mixed units"))).select((F.col("form") + 1).alias("form"), F.lit(True).alias("after_mixed"))
    good = r.where(F.size("problems") == 0).join(mixed, "form", "left").where((F.col("form") % 2 == 0) | F.col("after_mixed"))
    best = good.groupBy("spec").agg(F.min_by(F.struct("how", "kind", "x", F.col("shown").alias("series")), "form").alias("b"))
    return specs.select("spec").join(best, "spec", "left").select("spec", "b.how", "b.kind", "b.x", "b.series")
