"""Queries of chart specs over the grids printed from orders: each nation's table with years down, and the same with years across."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.periods import find_period
from ..operators import rewrites as R
from ..operators import specs as S
from ..operators import tables as T
from ..operators.shared import stored
from .registry import registry
from .table_queries import grid

QUERIES, ORACLES, register = registry()

#: Specs that each nation's tables are asked for. T: years down, U: years across, V: the next nation's, W: no table.
ASKED = [
    {"kind": "line", "tables": ["T"], "series": ["T:building", "T:machinery"]}, {"kind": "line", "tables": ["U"], "series": ["U:building", "U:household"], "x": "U:period", "highlight": ["FY1994", "U:building"]},
    {"kind": "bar", "tables": ["T"], "series": ["T:furniture"], "categories": ["T:fy1995", "T:fy1993"]}, {"kind": "table", "tables": ["T"], "series": ["T:household", "T:machinery", "T:building"]},
    {"kind": "line", "tables": ["T", "V"], "series": ["T:building", "V:building"], "periods": ["FY1993", "FY1994"]}, {"kind": "grouped_bar", "tables": ["U"], "series": ["U:building", "U:household", "U:machinery"], "periods": ["FY1996"]},
    {"kind": "comparison", "tables": ["U"], "series": ["U:building"], "periods": ["FY1995"]}, {"kind": "donut", "tables": ["T"], "series": ["T:machinery"]}, {"kind": "donut", "tables": ["U"], "series": ["U:fy1994"]},
    {"kind": "stacked_bar", "tables": ["T"], "series": ["T:furniture", "T:building"]}, {"kind": "line", "tables": ["U"], "series": ["U:fy1994"], "x": "U:rows"}, {"kind": "waterfall", "tables": ["T"], "series": ["T:building"], "categories": ["T:fy1993", "T:total"]},
    {"kind": "bar", "tables": ["W"], "series": ["W:building"]}, {"kind": "bar", "tables": ["T"], "series": []}, {"kind": "bar", "tables": ["T"], "series": ["T:building"], "x": "T:nothing"}, {"kind": "bar", "tables": ["T"], "series": ["T:building"], "x": "U:rows"},
    {"kind": "bar", "tables": ["T"], "series": ["building", "T:", "U:building", "T:year", "T:nothing", "T:building", "T:fy1994"], "categories": ["x", "U:fy1993"]}, {"kind": "bar", "tables": ["T"], "series": ["T:building"], "categories": ["T:machinery"]},
    {"kind": "bar", "tables": ["T"], "series": ["T:fy1994"], "x": "T:rows"}, {"kind": "bar", "tables": ["T"], "series": ["T:building"], "periods": ["FY1890", "FY1994"]}, {"kind": "table", "tables": ["U"], "series": ["U:building"], "x": "U:columns", "categories": ["U:fy1995"]},
    {"kind": "comparison", "tables": ["U"], "series": ["U:building", "U:machinery"], "periods": ["FY1994", "FY1995", "FY1996"]}, {"kind": "waterfall", "tables": ["T"], "series": ["T:building"], "periods": ["FY1994"]}, {"kind": "line", "tables": ["T"], "series": ["T:building", "T:building"], "highlight": ["T:machinery", "FY1890"]},
    {"kind": "line", "tables": ["T"], "series": ["T:building"], "calculations": [{"op": "ratio", "series": "T:building"}, {"op": "growth", "series": "T:machinery"}, {"op": "growth", "series": "T:building", "from": "T:fy1994", "to": "FY1890"}]},
    {"kind": "kpi", "tables": ["T", "U"], "series": ["T:automobile", "T:building", "T:furniture", "T:household", "T:machinery", "U:automobile", "U:building"]}, {"kind": "grouped_bar", "tables": ["T"], "series": ["T:building"]}, {"kind": "bar", "tables": ["T"], "series": ["T:automobile", "T:building", "T:furniture", "T:household", "T:machinery"]},
]


def printed(spark, sf_dir) -> S.Tables:
    """The printed grids as tables: T and the nation's number with years down, U with years across; one segment of every third table in USD, one of every fourth negative."""
    g = stored(T.parsed(grid(spark, sf_dir)).select("table_id", "row", "col", "text", "value", "status"), "spec-grid")
    slug = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    part = lambda where, at: g.where(where).select("table_id", F.col(at).alias("idx"), F.col("text").alias("label"), slug(F.col("text")).alias("key"))
    p = F.col("p")
    years = part("col = 0 AND row > 0", "row").withColumn("p", find_period(F.col("label"))).select("table_id", "idx", "label", "key", F.when(p.isNotNull(), F.col("label")).alias("period"), p["granularity"].alias("granularity"), p["end"].alias("end"))
    segments = part("row = 0 AND col > 0", "col").select("table_id", "idx", "label", "key", F.lit(None).cast("string").alias("period"), F.lit(None).cast("string").alias("granularity"), F.lit(None).cast("date").alias("end"))
    named = lambda d, letter: d.withColumn("table", F.concat(F.lit(letter), F.col("table_id").cast("string"))).drop("table_id")
    total = F.when(F.col("label") == "Total", "total").otherwise("data")
    rows = lambda d: d.withColumn("type", total).withColumn("section", F.lit(""))
    columns = lambda d: d.where("label <> 'Total'").withColumn("type", F.lit("currency")).withColumn("measure", F.lit(None).cast("string"))
    label = g.where("row = 0 AND col = 0").select("table_id", F.lit(0).alias("idx"), F.col("text").alias("label"), slug(F.col("text")).alias("key"), F.lit(None).cast("string").alias("period"), F.lit(None).cast("string").alias("granularity"), F.lit(None).cast("date").alias("end"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("measure"))
    ids, document = g.select("table_id").distinct(), F.regexp_extract("table", "[0-9]+", 0).alias("document")
    tables = named(ids, "T").select("table", document, F.lit("rows").alias("period_axis"), F.lit("year").alias("label_key")).unionByName(named(ids, "U").select("table", document, F.lit("columns").alias("period_axis"), F.lit("segment").alias("label_key")))
    added = years.where("label <> 'Total'").groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "key"))), lambda k: k["key"]).alias("added"))
    down = named(rows(years).join(added, "table_id").withColumn("parts", F.when(F.col("type") == "total", F.col("added"))).drop("added"), "T")
    across = named(rows(segments).withColumn("parts", F.lit(None).cast("array<string>")), "U")
    heads = named(columns(segments).unionByName(label), "T").unionByName(named(columns(years).unionByName(label.withColumn("label", F.lit("Segment")).withColumn("key", F.lit("segment"))), "U"))
    body = g.where("row > 0 AND col > 0").join(years.select("table_id", F.col("idx").alias("row"), F.col("key").alias("year")), ["table_id", "row"]).join(segments.select("table_id", F.col("idx").alias("col"), F.col("key").alias("segment")), ["table_id", "col"])
    flip = (F.col("table_id") % 4 == 0) & (F.col("segment") == "furniture")
    body = body.select("table_id", "year", "segment", F.when(F.col("status") == "number", F.when(flip, -F.col("value")).otherwise(F.col("value"))).alias("value"), F.when((F.col("table_id") % 3 == 0) & (F.col("segment") == "household"), "USD").otherwise("INR").alias("unit"))
    cells = named(body.select("table_id", F.col("year").alias("row"), F.col("segment").alias("col"), "value", "unit"), "T").unionByName(named(body.select("table_id", F.col("segment").alias("row"), F.col("year").alias("col"), "value", "unit"), "U"))
    frames = zip((tables, down.unionByName(across), heads, cells), S.Tables._fields, strict=True)
    return S.Tables(*[stored(frame, f"spec-{name}") for frame, name in frames])


def asked(tables: S.Tables, specs: list[dict] = ASKED) -> DataFrame:
    """Every one of specs for every nation."""
    shape = "array<struct<" + S.SPEC.removeprefix("spec long, ").replace(" array<", ":array<").replace(" string", ":string").replace(", ", ",") + ">>"
    n = F.regexp_extract("table", "[0-9]+", 0)
    own = tables.tables.where("table LIKE 'T%'").withColumn("n", n)
    text = F.lit(json.dumps(specs))
    for letter, name in (("T", F.concat(F.lit("T"), "n")), ("U", F.concat(F.lit("U"), "n")), ("V", F.concat(F.lit("T"), ((F.col("n").cast("int") + 1) % 25).cast("string")))):
        text = F.regexp_replace(text, F.lit(f'"{letter}(?=[":])'), F.concat(F.lit('"'), name))
    return own.select("n", F.posexplode(F.from_json(text, shape)).alias("i", "s")).select((F.col("n").cast("long") * 1000 + F.col("i")).alias("spec"), "s.*")


@register()
def vq01_resolved_specs(spark, sf_dir):
    """JN-23, JN-24, VQ-01, VQ-02: what each spec shows, or everything that stands against it."""
    tables = printed(spark, sf_dir)
    return S.resolved(stored(asked(tables), "spec-asked"), tables)


#: Specs that don't stand as given: each is mended by another rewrite, the last two by none and by being cut to one document.
MENDED = [
    {"kind": "line", "tables": ["T"], "series": ["T:building"], "periods": ["FY1994", "FY1995"]}, {"kind": "donut", "tables": ["U"], "series": ["U:building", "U:machinery", "U:automobile"]}, {"kind": "waterfall", "tables": ["T"], "series": ["T:fy1993", "T:fy1994"]},
    {"kind": "waterfall", "tables": ["U"], "series": ["U:building", "U:machinery"], "periods": ["FY1994"]}, {"kind": "bar", "tables": ["T"], "series": ["T:building"], "highlight": ["nothing"]}, {"kind": "bar", "tables": ["T"], "series": ["T:building"], "categories": ["T:nothing"]},
    {"kind": "line", "tables": ["U"], "series": ["U:building", "U:machinery", "U:automobile", "U:furniture", "U:household"]}, {"kind": "donut", "tables": ["T"], "series": ["T:machinery"]}, {"kind": "stacked_bar", "tables": ["U"], "series": ["U:fy1994"]}, {"kind": "stacked_bar", "tables": ["U"], "series": ["U:fy1994", "U:fy1995"]},
    {"kind": "waterfall", "tables": ["U"], "series": ["U:fy1995"], "categories": ["U:building", "U:nothing"]}, {"kind": "grouped_bar", "tables": ["T"], "series": ["T:building", "T:household", "T:machinery"]}, {"kind": "bar", "tables": ["T", "W"], "series": ["T:building"]}, {"kind": "grouped_bar", "tables": ["T", "V"], "series": ["T:building", "V:building"]},
    {"kind": "line", "tables": ["T"], "series": ["T:building", "U:machinery"]}, {"kind": "bar", "tables": ["U"], "series": ["U:fy1994"]}, {"kind": "comparison", "tables": ["U"], "series": ["U:building", "U:machinery", "U:automobile", "U:furniture"]},
]


@register()
def vq10_rewrites(spark, sf_dir):
    """VQ-10, VQ-14's first that stands: the first form of each spec that resolves, of all that are tried."""
    tables = printed(spark, sf_dir)
    return R.first_valid(stored(asked(tables, ASKED + MENDED), "spec-asked"), tables)


@register()
def vq10_one_document(spark, sf_dir):
    """VQ-10: specs over several documents' tables, cut to those of one."""
    tables = printed(spark, sf_dir)
    return S.resolved(stored(R.one_document(asked(tables, ASKED + MENDED), tables), "spec-asked"), tables)
