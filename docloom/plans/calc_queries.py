"""Queries of fiscal periods, calculations and chart layouts over orders and lineitem (F5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from .registry import registry, table

QUERIES, ORACLES, register = registry()

YEARLY = """y AS (SELECT year(o_orderdate) + (month(o_orderdate) > 3)::INT AS fy, c_mktsegment AS segment, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def yearly(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(N.fiscal_year(F.col("o_orderdate")).alias("fy"), "segment").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@register("""SELECT o_orderkey, year(o_orderdate)::INTEGER + (month(o_orderdate) > 3)::INT AS fy, CAST((month(o_orderdate) + 8) % 12 // 3 + 1 AS INTEGER) AS quarter,
    ((month(o_orderdate) + 8) % 12 // 3 + 1) || 'QFY' || lpad(((year(o_orderdate) + (month(o_orderdate) > 3)::INT) % 100)::VARCHAR, 2, '0') AS label,
    CASE WHEN (month(o_orderdate) + 8) % 12 // 3 + 1 <= 2 THEN 'H1' ELSE 'H2' END || 'FY' || lpad(((year(o_orderdate) + (month(o_orderdate) > 3)::INT) % 100)::VARCHAR, 2, '0') AS half,
    make_date(year(o_orderdate) + (month(o_orderdate) > 3)::INT, 3, 31) AS fy_end, last_day(o_orderdate::DATE) AS month_end FROM orders""")
def sc54_fiscal_periods(spark, sf_dir):
    """SC-52, SC-54."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.fiscal_year(d).alias("fy"), N.fiscal_quarter(d).alias("quarter"), N.fiscal_label(d, "quarter").alias("label"), N.fiscal_label(d, "half").alias("half"), N.fiscal_end(d).alias("fy_end"), F.last_day(d).alias("month_end"))


@register(f"WITH {YEARLY}, l AS (SELECT *, lag(total) OVER (PARTITION BY segment ORDER BY fy) AS before FROM y) SELECT segment, fy::INTEGER AS fy, total, CASE WHEN before > 0 THEN round(100 * (total - before) / before, 1) + 0.0 END AS growth, round(total - before, 2) + 0.0 AS diff FROM l")
def ag28_growth(spark, sf_dir):
    """AG-28 growth and difference."""
    before = F.lag("total").over(Window.partitionBy("segment").orderBy("fy"))
    return yearly(spark, sf_dir).select("segment", "fy", "total", N.growth(before, F.col("total")).alias("growth"), N.difference(before, F.col("total"), 2).alias("diff"))


@register(f"WITH {YEARLY}, e AS (SELECT segment, arg_min(total, fy) AS a, arg_max(total, fy) AS b, (max(fy) - min(fy))::DOUBLE AS years FROM y GROUP BY 1) SELECT segment, years, CASE WHEN a > 0 AND b > 0 AND years >= 1 THEN round(100 * (pow(b / a, 1 / years) - 1), 1) + 0.0 END AS cagr FROM e")
def ag28_cagr(spark, sf_dir):
    """AG-28 cagr, SC-55: between the first and the last fiscal year's end."""
    end = lambda c: F.make_date(c, F.lit(3), F.lit(31))
    e = yearly(spark, sf_dir).groupBy("segment").agg(F.min_by("total", "fy").alias("a"), F.max_by("total", "fy").alias("b"), F.min("fy").alias("f"), F.max("fy").alias("l"))
    e = e.withColumn("years", N.years_between(end(F.col("f")), end(F.col("l"))))
    return e.select("segment", "years", N.cagr(F.col("a"), F.col("b"), F.col("years")).alias("cagr"))


@register(f"WITH {YEARLY}, w AS (SELECT *, sum(total) OVER (PARTITION BY fy) AS whole FROM y) SELECT fy::INTEGER AS fy, segment, CASE WHEN whole > 0 AND total >= 0 THEN round(100 * total / whole, 1) END AS share, round(total / nullif(n, 0), 2) AS each FROM w")
def ag28_share_ratio(spark, sf_dir):
    """AG-28 share and ratio."""
    whole = F.sum("total").over(Window.partitionBy("fy"))
    return yearly(spark, sf_dir).select("fy", "segment", N.share(F.col("total"), whole).alias("share"), N.ratio(F.col("total"), F.col("n").cast("double")).alias("each"))


@register(f"WITH {YEARLY} SELECT fy::INTEGER AS fy, round(sum(total), 2) AS total, count(*) AS inputs FROM y GROUP BY 1 HAVING count(*) >= 2")
def ag28_sum(spark, sf_dir):
    """AG-28 sum: two inputs at least."""
    return yearly(spark, sf_dir).groupBy("fy").agg(F.round(F.sum("total"), 2).alias("total"), F.count(F.lit(1)).alias("inputs")).where("inputs >= 2")


@register(f"WITH {YEARLY}, s AS (SELECT segment, fy, total, round(total / 1000000, 1) AS shown, CASE WHEN fy % 4 = 0 THEN round(total / 1000000, 1) + 0.2 ELSE round(total / 1000000, 1) END AS claimed FROM y) SELECT segment, fy::INTEGER AS fy, claimed FROM s WHERE abs(claimed - total / 1000000) > 0.05 + 1e-9")
def ag30_grounding_audit(spark, sf_dir):
    """AG-29, AG-30: figures shown in millions against their cells; every fourth year's claim is off and must be listed."""
    shown = F.round(F.col("total") / 1000000, 1)
    y = yearly(spark, sf_dir).withColumn("claimed", F.when(F.col("fy") % 4 == 0, shown + 0.2).otherwise(shown))
    return y.where(~N.agrees(F.col("claimed"), F.col("total") / 1000000, 1)).select("segment", "fy", "claimed")


@register(f"WITH {YEARLY}, l AS (SELECT max(fy) AS last FROM y) SELECT segment, max(total) FILTER (WHERE fy = last - 1) AS before, max(total) FILTER (WHERE fy = last) AS after, round(max(total) FILTER (WHERE fy = last) - max(total) FILTER (WHERE fy = last - 1), 2) AS diff FROM y, l GROUP BY 1")
def vq08_comparison(spark, sf_dir):
    """VQ-08: the last two years side by side."""
    y = yearly(spark, sf_dir)
    last = y.select(F.max("fy").alias("last"))
    at = lambda k: F.max(F.when(F.col("fy") == F.col("last") - k, F.col("total")))
    return y.join(F.broadcast(last)).groupBy("segment").agg(at(1).alias("before"), at(0).alias("after"), F.round(at(0) - at(1), 2).alias("diff"))


@register(f"WITH {YEARLY} SELECT fy::INTEGER AS fy, max(total) FILTER (WHERE segment = 'AUTOMOBILE') AS automobile, max(total) FILTER (WHERE segment = 'BUILDING') AS building, max(total) FILTER (WHERE segment = 'MACHINERY') AS machinery FROM y GROUP BY 1")
def vq04_grouped_bar(spark, sf_dir):
    """VQ-04, SC-74: long rows to one row for each year."""
    p = yearly(spark, sf_dir).groupBy("fy").pivot("segment", ["AUTOMOBILE", "BUILDING", "MACHINERY"]).agg(F.max("total"))
    return p.select("fy", *[F.col(s).alias(s.lower()) for s in ("AUTOMOBILE", "BUILDING", "MACHINERY")])


@register(f"WITH {YEARLY}, f AS (SELECT segment, arg_min(total, fy) AS first, arg_max(total, fy) AS last, max(fy)::INTEGER AS at_year FROM y WHERE fy >= 1997 GROUP BY 1) SELECT segment, at_year, round(last - first, 2) AS change, CASE WHEN last > first THEN 'up' WHEN last < first THEN 'down' ELSE 'flat' END AS trend FROM f")
def vq09_requested(spark, sf_dir):
    """VQ-09, AG-31: a calculation over the chosen years' first and last value."""
    f = yearly(spark, sf_dir).where("fy >= 1997").groupBy("segment").agg(F.min_by("total", "fy").alias("first"), F.max_by("total", "fy").alias("last"), F.max("fy").alias("at_year"))
    return f.select("segment", "at_year", F.round(F.col("last") - F.col("first"), 2).alias("change"), F.when(F.col("last") > F.col("first"), "up").when(F.col("last") < F.col("first"), "down").otherwise("flat").alias("trend"))


@register(f"""WITH {YEARLY}, s AS (SELECT segment, (max(total) - min(total)) / 5 AS raw, min(total) AS lo, max(total) AS hi FROM y GROUP BY 1), p AS (SELECT *, pow(10.0, floor(log10(raw))) AS p FROM s),
    t AS (SELECT segment, lo, hi, p * CASE WHEN raw / p >= sqrt(50) THEN 10 WHEN raw / p >= sqrt(10) THEN 5 WHEN raw / p >= sqrt(2) THEN 2 ELSE 1 END AS step FROM p) SELECT segment, step, round(floor(lo / step) * step, 4) AS from_tick, round(ceil(hi / step) * step, 4) AS to_tick FROM t""")
def sc58_nice_ticks(spark, sf_dir):
    """SC-58."""
    s = yearly(spark, sf_dir).groupBy("segment").agg(F.min("total").alias("lo"), F.max("total").alias("hi")).withColumn("step", N.nice_step(F.col("hi") - F.col("lo"), 5))
    return s.select("segment", "step", F.round(F.floor(F.col("lo") / F.col("step")) * F.col("step"), 4).alias("from_tick"), F.round(F.ceil(F.col("hi") / F.col("step")) * F.col("step"), 4).alias("to_tick"))


@register("SELECT user_id, event_id, round(coalesce((epoch_us(ts) - min(epoch_us(ts)) OVER w) / nullif(max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w, 0)::DOUBLE, 0), 6) AS place FROM events WINDOW w AS (PARTITION BY user_id)")
def sc59_time_positions(spark, sf_dir):
    """SC-59."""
    t, w = F.unix_micros(F.col("ts").cast("timestamp")), Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.coalesce(F.try_divide((t - F.min(t).over(w)).cast("double"), (F.max(t).over(w) - F.min(t).over(w)).cast("double")), F.lit(0.0)), 6).alias("place"))


@register("SELECT event_id, round(CASE WHEN value > 0 THEN greatest(-90, 10 * log10((value / 1000) * (value / 1000))) ELSE -90 END, 6) AS level, round(0.3 + least(1, greatest(0, (value - 20) / 60)) * 0.4, 6) AS threshold FROM events")
def sc62_levels(spark, sf_dir):
    """SC-62, SC-63: a frame's level, and a threshold that follows the noise."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(N.dbfs((v / 1000) * (v / 1000)), 6).alias("level"), F.round(N.between(v, 20, 80, 0.3, 0.7), 6).alias("threshold"))


@register("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '−' ELSE '' END || format('{:,.1f}', round(o_totalprice, 1)) AS western,
    CASE WHEN o_orderkey % 2 = 0 THEN '−' ELSE '' END || CASE WHEN length(i) <= 3 THEN i WHEN length(i) <= 5 THEN left(i, length(i) - 3) || ',' || right(i, 3) WHEN length(i) <= 7 THEN left(i, length(i) - 5) || ',' || substr(i, length(i) - 4, 2) || ',' || right(i, 3) END AS indian
    FROM (SELECT *, round(o_totalprice, 0)::BIGINT::VARCHAR AS i FROM orders)""")
def sc56_number_formats(spark, sf_dir):
    """SC-56, SC-57."""
    v = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.western(F.round(v, 1), 1).alias("western"), N.indian(v).alias("indian"))


PRINTED = """CASE o_orderkey % 7 WHEN 0 THEN '₹ ' || i || ' crore' WHEN 1 THEN '(' || i || ')' WHEN 2 THEN i || '.25%' WHEN 3 THEN '–' WHEN 4 THEN 'about ' || i WHEN 5 THEN '-$' || i ELSE i || 'x' END"""


@register(f"""WITH p AS (SELECT o_orderkey, o_orderkey % 7 AS k, (o_orderkey % 900 + 1)::VARCHAR AS i FROM orders)
    SELECT o_orderkey, CASE k WHEN 3 THEN 'null_marker' WHEN 4 THEN 'text' ELSE 'number' END AS status, CASE k WHEN 1 THEN -i::DOUBLE WHEN 5 THEN -i::DOUBLE WHEN 2 THEN i::DOUBLE + 0.25 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE i::DOUBLE END AS value,
    CASE k WHEN 0 THEN 'amount' WHEN 1 THEN 'plain' WHEN 2 THEN 'percent' WHEN 5 THEN 'amount' WHEN 6 THEN 'ratio' END AS kind, CASE k WHEN 0 THEN 'INR' WHEN 5 THEN 'USD' END AS currency, CASE WHEN k = 0 THEN 'crore' END AS scale, CASE WHEN k = 2 THEN 2 WHEN k IN (3, 4) THEN NULL ELSE 0 END::INTEGER AS decimals FROM p""")
def sc50_quantities(spark, sf_dir):
    """SC-50, FLT-19, FLT-20: numbers printed in seven ways from the order keys and parsed back."""
    k, i = F.col("o_orderkey") % 7, (F.col("o_orderkey") % 900 + 1).cast("string")
    t = F.when(k == 0, F.concat(F.lit("₹ "), i, F.lit(" crore"))).when(k == 1, F.concat(F.lit("("), i, F.lit(")"))).when(k == 2, F.concat(i, F.lit(".25%"))).when(k == 3, "–").when(k == 4, F.concat(F.lit("about "), i)).when(k == 5, F.concat(F.lit("-$"), i)).otherwise(F.concat(i, F.lit("x")))
    q = table(spark, sf_dir, "orders").select("o_orderkey", N.quantity(t).alias("q"))
    return q.select("o_orderkey", *[F.col(f"q.{n}").alias(n) for n in ("status", "value", "kind", "currency", "scale", "decimals")])


@register("""SELECT o_orderkey, list_sort(list_distinct([CASE WHEN o_orderkey % 2 = 0 THEN fy END, CASE WHEN o_orderkey % 3 = 0 THEN fy - 1 END])) AS years FROM (SELECT *, year(o_orderdate)::INTEGER + (month(o_orderdate) > 3)::INT + 10 AS fy FROM orders)""".replace("list_sort(list_distinct([", "list_sort(list_filter(list_distinct([").replace("END])) AS years", "END]), lambda y: y IS NOT NULL)) AS years"))
def sc53_stated_years(spark, sf_dir):
    """SC-53: fiscal years that a sentence names, as FY2010 or FY 2008-09."""
    o = table(spark, sf_dir, "orders").withColumn("fy", N.fiscal_year(F.col("o_orderdate")) + 10)
    a = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" fell in FY"), F.col("fy").cast("string"))).otherwise("")
    b = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" rose in FY "), (F.col("fy") - 2).cast("string"), F.lit("-"), F.lpad(((F.col("fy") - 1) % 100).cast("string"), 2, "0"))).otherwise("")
    return o.select("o_orderkey", N.stated_years(F.concat(F.lit("Sales"), a, b)).alias("years"))
