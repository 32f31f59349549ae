"""Queries of periods in texts (SC-52)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import periods as P
from .registry import registry, table

QUERIES, ORACLES, register = registry()

CAPTIONS_SQL = """
    d AS (SELECT o_orderdate::DATE AS d, count(*) AS orders, year(o_orderdate) + (month(o_orderdate) > 3)::INT AS fy, (month(o_orderdate) + 8) % 12 // 3 + 1 AS q, year(o_orderdate) AS y, month(o_orderdate) AS m
        FROM orders GROUP BY ALL),
    p AS (SELECT *, unnest(range(12)) AS form FROM d)"""


def captions(spark, sf_dir):
    """Each day of orders as the caption of a table, with its date printed in twelve forms: day, orders, form, caption."""
    d = F.col("day")
    fy = F.year(d) + (F.month(d) > 3).cast("int")
    q = (F.floor((F.month(d) + 8) % 12 / 3) + 1).cast("string")
    span = F.concat((fy - 1).cast("string"), F.lit("-"), F.lpad((fy % 100).cast("string"), 2, "0"))
    forms = [
        F.concat(F.lit("FY"), F.lpad((fy % 100).cast("string"), 2, "0")), F.concat(F.lit("Q"), q, F.lit(" FY "), span), F.concat(q, F.lit("QFY"), F.lpad((fy % 100).cast("string"), 2, "0")),
        F.concat(F.lit("H"), F.when(q <= "2", "1").otherwise("2"), F.lit(" fy'"), span), F.concat(F.lit("nine months FY"), fy.cast("string")), F.concat(F.lit("for the year ended "), F.date_format(d, "d MMMM yyyy")),
        F.date_format(d, "MMMM d, yyyy"), F.date_format(d, "dd.MM.yyyy"), F.date_format(d, "yyyy-MM-dd"), F.concat(F.lit("("), span, F.lit(")")), F.date_format(d, "MMM-yy"), F.concat(F.lit("CY "), F.year(d).cast("string")),
    ]
    caption = lambda f: F.concat_ws(" ", F.lit("Orders received"), f, F.lit("*"))
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    return days.select("day", "orders", F.posexplode(F.array(*map(caption, forms))).alias("form", "caption"))


@register(f"""WITH {CAPTIONS_SQL}, e AS (SELECT *, 'FY' || lpad((fy % 100)::VARCHAR, 2, '0') AS f, day(d) || ' ' || strftime(d, '%b %Y') AS shown,
        CASE q WHEN 4 THEN make_date(fy, 3, 31) ELSE last_day(make_date(fy - 1, (3 + 3 * q)::INT, 1)) END AS quarter_end FROM p)
    SELECT d AS day, orders, form::INTEGER AS form, 'Orders received' AS rest,
        CASE WHEN form IN (0, 9) THEN f WHEN form IN (1, 2) THEN 'Q' || q || ' ' || f WHEN form = 3 THEN CASE WHEN q <= 2 THEN 'H1 ' ELSE 'H2 ' END || f WHEN form = 4 THEN '9M ' || f
            WHEN form = 5 THEN CASE m WHEN 3 THEN 'FY' || lpad((y % 100)::VARCHAR, 2, '0') WHEN 12 THEN y::VARCHAR ELSE 'YE ' || shown END WHEN form IN (6, 7, 8) THEN shown
            WHEN form = 10 THEN strftime(d, '%b %Y') ELSE y::VARCHAR END AS label,
        CASE WHEN form IN (0, 9) THEN 'fy' WHEN form IN (1, 2) THEN 'quarter' WHEN form = 3 THEN 'half' WHEN form = 4 THEN 'nine_months' WHEN form = 5 THEN CASE m WHEN 3 THEN 'fy' ELSE 'year' END
            WHEN form IN (6, 7, 8) THEN 'date' WHEN form = 10 THEN 'month' ELSE 'year' END AS kind,
        CASE WHEN form IN (0, 9) THEN make_date(fy, 3, 31) WHEN form IN (1, 2) THEN quarter_end WHEN form = 3 THEN CASE WHEN q <= 2 THEN make_date(fy - 1, 9, 30) ELSE make_date(fy, 3, 31) END
            WHEN form = 4 THEN make_date(fy - 1, 12, 31) WHEN form IN (5, 6, 7, 8) THEN d WHEN form = 10 THEN last_day(d) ELSE make_date(y, 12, 31) END AS period_end,
        CAST(CASE WHEN form IN (0, 5, 9, 11) THEN 12 WHEN form IN (1, 2) THEN 3 WHEN form = 3 THEN 6 WHEN form = 4 THEN 9 WHEN form = 10 THEN 1 ELSE 0 END AS INTEGER) AS months
    FROM e""")
def sc52_caption_periods(spark, sf_dir):
    """SC-52: the period that each caption states, and the caption without it; the SQL works from the dates, not the captions."""
    found = captions(spark, sf_dir).withColumn("p", P.find_period(F.col("caption")))
    return found.select("day", "orders", "form", "p.rest", "p.label", "p.kind", F.col("p.end").alias("period_end"), "p.months")


@register()
def sc52_line_periods(spark, sf_dir):
    """SC-52: the period of every line of documents, pages and conversations that states one."""
    parts = None
    for name, key, turn, text in (("documents", "doc_id", F.lit(0), "text"), ("pages", "page_id", F.lit(0), "html"), ("conversations", "conv_id", F.col("turn"), "text")):
        rows = table(spark, sf_dir, name).where(F.col(text).rlike("[0-9०-९]"))
        lines = rows.select(F.lit(name).alias("part"), F.col(key).cast("string").alias("key"), turn.cast("int").alias("turn"), F.posexplode(F.split(text, "\n")).alias("line", "text"))
        parts = lines if parts is None else parts.unionByName(lines)
    found = parts.where(F.col("text").rlike("[0-9०-९]")).withColumn("p", P.find_period(F.col("text"))).where("p IS NOT NULL")
    return found.select("part", "key", "turn", "line", "p.label", "p.kind", "p.end", "p.months", "p.granularity")
