"""Queries of table typing over grids printed from orders: a table for each nation, fiscal years down, segments across, a total row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import fiscal_year
from ..operators import tables as T
from .registry import registry, table

QUERIES, ORACLES, register = registry()

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def sums(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), o.o_custkey == c.c_custkey)
    return j.groupBy(F.col("c_nationkey").cast("long").alias("table_id"), fiscal_year(F.col("o_orderdate")).alias("fy"), F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum("o_totalprice") / 1000, 0).cast("long").alias("v"))


SUMS = "s AS (SELECT c_nationkey::BIGINT AS table_id, year(o_orderdate)::INTEGER + (month(o_orderdate) > 3)::INT AS fy, c_mktsegment AS segment, CAST(round(sum(o_totalprice) / 1000, 0) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def grid(spark, sf_dir):
    """Printed cells; row 0 is the header, the last row the total, a missing sum a dash."""
    s = sums(spark, sf_dir)
    years = s.groupBy("table_id").agg(F.min("fy").alias("lo"), F.max("fy").alias("hi"))
    frame = years.select("table_id", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("fy"))
    body = frame.withColumn("segment", F.explode(F.array(*map(F.lit, SEGMENTS)))).join(s, ["table_id", "fy", "segment"], "left")
    number = F.coalesce(F.format_number("v", 0), F.lit("–"))
    cells = body.select("table_id", (F.col("fy") - F.col("lo") + 1).cast("int").alias("row"), F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("segment")).cast("int").alias("col"), number.alias("text"))
    total = body.groupBy("table_id", "lo", "hi", "segment").agg(F.sum("v").alias("v"))
    cells = cells.unionByName(total.select("table_id", (F.col("hi") - F.col("lo") + 2).cast("int").alias("row"), F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("segment")).cast("int").alias("col"), number.alias("text")))
    labels = frame.select("table_id", (F.col("fy") - F.col("lo") + 1).cast("int").alias("row"), F.lit(0).alias("col"), F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("text"))
    ends = years.select("table_id", (F.col("hi") - F.col("lo") + 2).cast("int").alias("row"), F.lit(0).alias("col"), F.lit("Total").alias("text"))
    head = years.select("table_id", F.lit(0).alias("row"), F.posexplode(F.array(F.lit("Year"), *map(F.lit, SEGMENTS))).alias("col", "text"))
    return cells.unionByName(labels).unionByName(ends).unionByName(head)


SEG = "['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']"
GRID = f"""{SUMS}, y AS (SELECT table_id, min(fy) AS lo, max(fy) AS hi FROM s GROUP BY 1), fr AS (SELECT table_id, lo, hi, unnest(range(lo, hi + 1))::INTEGER AS fy FROM y), bo AS (SELECT fr.*, g.segment, v FROM fr CROSS JOIN (SELECT unnest({SEG}) AS segment) g LEFT JOIN s ON s.table_id = fr.table_id AND s.fy = fr.fy AND s.segment = g.segment),
    numbers AS (SELECT table_id, fy - lo + 1 AS row, list_position({SEG}, segment)::INTEGER AS col, v FROM bo UNION ALL SELECT table_id, hi - lo + 2, list_position({SEG}, segment)::INTEGER, sum(v)::BIGINT FROM bo GROUP BY table_id, lo, hi, segment)"""


@register(f"WITH {GRID} SELECT table_id, 1::INTEGER AS header_rows FROM y")
def sc72_header_rows(spark, sf_dir):
    """SC-72."""
    return T.header_rows(T.parsed(grid(spark, sf_dir)))


@register(f"""WITH {GRID} SELECT table_id, 0::INTEGER AS col, 0::BIGINT AS numbers, 1::BIGINT AS texts, (hi - lo + 1)::BIGINT AS periods, 'period' AS type FROM y
    UNION ALL SELECT table_id, col, count(v), 0, 0, CASE WHEN count(v) = 0 THEN 'empty' ELSE 'number' END FROM numbers GROUP BY ALL""")
def sc73_column_types(spark, sf_dir):
    """SC-73."""
    p = T.parsed(grid(spark, sf_dir))
    return T.column_types(p, T.header_rows(p))


@register(f"WITH {GRID}, f AS (SELECT table_id, col, max(row) AS last FROM numbers WHERE v IS NOT NULL GROUP BY ALL) SELECT n.table_id, n.col, n.row::INTEGER AS row, n.row = y.hi - y.lo + 2 AND k.n >= 2 AS is_total, CASE WHEN n.row = y.hi - y.lo + 2 AND k.n >= 2 THEN k.n ELSE 0 END AS parts FROM numbers n JOIN y USING (table_id) JOIN (SELECT table_id, col, count(v) - 1 AS n FROM numbers GROUP BY ALL) k ON k.table_id = n.table_id AND k.col = n.col WHERE v IS NOT NULL")
def ag27_totals(spark, sf_dir):
    """AG-27: the printed total rows are found, and no other row, as no year's sum happens to equal those above it."""
    p = T.parsed(grid(spark, sf_dir)).where("col > 0 AND row > 0 AND status = 'number'")
    return T.totals(p)


@register(f"WITH {GRID}, c AS (SELECT table_id, 'plain' AS kind, count(v) AS n, count(v) AS total FROM numbers GROUP BY 1) SELECT table_id, kind, n, total, true AS quorum FROM c")
def ag24_majority_unit(spark, sf_dir):
    """AG-24, AG-26: the commonest kind of the numbers below the header."""
    p = T.parsed(grid(spark, sf_dir)).where("row > 0 AND status = 'number'").withColumn("pos", F.col("row") * 100 + F.col("col"))
    return T.majority(p, ["table_id"], "kind", "pos")


@register(f"WITH {GRID} SELECT table_id, col, 'plain' AS kind, 0::INTEGER AS decimals FROM numbers GROUP BY ALL HAVING count(v) > 0")
def ag25_unanimous_unit(spark, sf_dir):
    """AG-25."""
    p = T.parsed(grid(spark, sf_dir)).where("row > 0 AND status = 'number'")
    return p.groupBy("table_id", "col").agg(T.unanimous(F.col("kind")).alias("kind"), T.unanimous(F.col("decimals")).alias("decimals"))


@register(f"""WITH {GRID}, k AS (SELECT table_id, hi - lo + 1 AS n FROM y), m AS (SELECT table_id, count(*) AS m FROM (SELECT table_id, col FROM numbers GROUP BY ALL HAVING count(v) > 0) GROUP BY 1),
    o AS (SELECT table_id, 0 AS i, 'time_series' AS k, CASE WHEN n >= 4 THEN least(0.95, 0.85 + 0.02 * (n - 4)) WHEN n = 3 THEN 0.75 WHEN n = 2 THEN 0.5 ELSE 0 END::DOUBLE AS c FROM k
        UNION ALL SELECT table_id, 1, 'composition', greatest(0.65, 0.88 - 0.05 * greatest(m - 1, 0))::DOUBLE FROM m UNION ALL SELECT table_id, 2, 'categorical', 0.75 FROM k)
    SELECT table_id, arg_min(k, {{'c': -c, 'i': i}}) AS best, round(max(c), 4) AS confidence, string_agg(k, ',' ORDER BY c DESC, i) AS options FROM o WHERE c > 0 GROUP BY 1""")
def ag33_chartability(spark, sf_dir):
    """AG-33, SO-11."""
    p = T.parsed(grid(spark, sf_dir))
    headers = T.header_rows(p)
    types = T.column_types(p, headers)
    t = types.groupBy("table_id").agg(F.max("periods").alias("periods"), F.count_if(F.col("type") == "number").alias("number_columns"))
    cells = p.join(headers, "table_id")
    named = F.when((F.col("row") < F.col("header_rows")) & (F.col("col") > 0) & (F.col("status") == "text"), F.col("text"))
    counts = cells.groupBy("table_id").agg(F.count_distinct(named).alias("categories"), F.count_if((F.col("row") >= F.col("header_rows")) & (F.col("value") < 0)).alias("negatives"))
    return T.chartability(t.join(counts, "table_id"))


@register("SELECT l_orderkey AS table_id, l_linenumber + d AS col, min_by(l_linenumber, l_linenumber)::INTEGER AS origin FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), (SELECT unnest([0, 1]) AS d) GROUP BY ALL".replace("min_by(", "arg_min("))
def sc71_spans(spark, sf_dir):
    """SC-71: cells two columns wide (one for each line of an order) spread over a grid; the first wins."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("col")).distinct()
    cells = li.select("table_id", F.lit(0).alias("row"), "col", F.lit(1).alias("row_span"), F.lit(2).alias("col_span"), F.col("col").cast("string").alias("text"))
    return T.expanded(cells).select("table_id", "col", F.col("text").cast("int").alias("origin"))


@register("""WITH t AS (SELECT c_nationkey AS g, c_custkey AS table_id, list_sort(list(DISTINCT o_orderpriority)) AS k, list(DISTINCT year(o_orderdate)::INTEGER) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
    SELECT a.g AS nation, a.table_id, b.table_id AS other_id FROM t a JOIN t b ON a.g = b.g AND a.k = b.k AND a.table_id < b.table_id WHERE NOT list_has_any(a.p, b.p)""")
def jn25_continuations(spark, sf_dir):
    """JN-25, AG-35's set tests: customers of a nation as tables with priorities for columns and years for periods."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("table_id")).agg(F.collect_set("o_orderpriority").alias("k"), F.collect_set(F.year("o_orderdate")).alias("p"))
    return T.continuations(t, "nation", "k", "p")


@register("""WITH s AS (SELECT o_custkey, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 2 = 0)) AS old, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderkey % 3 = 0)) AS new FROM orders GROUP BY 1)
    SELECT o_custkey, CASE WHEN list_has_all(old, new) AND list_has_all(new, old) THEN 'same' WHEN list_has_all(old, new) THEN 'covered' WHEN list_has_all(new, old) THEN 'extends' ELSE 'other' END AS relation,
    list_sort(list_intersect(old, new)) AS common, list_sort(list_distinct(list_concat(old, new))) AS either FROM s WHERE old IS NOT NULL AND new IS NOT NULL""")
def jn27_reuse(spark, sf_dir):
    """JN-27, SE-03 to SE-06: an older set of points against a newer one."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(k % 2 == 0, p)).alias("old"), F.collect_set(F.when(k % 3 == 0, p)).alias("new")).where("size(old) > 0 AND size(new) > 0")
    return s.select("o_custkey", T.coverage(F.col("old"), F.col("new")).alias("relation"), F.array_sort(F.array_intersect("old", "new")).alias("common"), F.array_sort(F.array_distinct(F.concat("old", "new"))).alias("either"))
