"""Queries of names as heard, key points that say the same, and totals of totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import guard as G
from ..functions.numbers import fiscal_quarter, fiscal_year
from ..functions.text import sentences
from ..operators import names as N
from ..operators import tables as T
from .registry import registry, table
from .table_queries import SEG, SEGMENTS

QUERIES, ORACLES, register = registry()


@register()
def jn21_heard_names(spark, sf_dir):
    """JN-21, SC-25: long words in title case of documents and conversations that are nearest to exactly one word of the benchmark's, with how often each occurs."""
    texts = table(spark, sf_dir, "documents").select("text").unionByName(table(spark, sf_dir, "conversations").select("text"))
    heard = texts.select(F.explode(N.heard_names(F.col("text"))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    lexicon = table(spark, sf_dir, "benchmark").select(F.explode(N.latin_words(F.col("text"))).alias("w")).where(F.length("w") >= N.LEXICON_LETTERS).select(F.lower("w").alias("word"))
    return N.corrections(heard, lexicon).join(heard, "word").select("word", "target", "edits", "n")


@register()
def ag35_key_points(spark, sf_dir):
    """AG-35: the points that assistants make in each conversation, a sentence each, repeats joined to the first with their turns as sources."""
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").cast("long").alias("key"), F.col("turn").cast("long").alias("turn"), F.posexplode(sentences(F.col("text"))).alias("i", "text"))
    return N.merged_points(said.select("key", F.struct("turn", "i").alias("pos"), "text", F.array("turn").alias("sources")))


LEDGER = f"""l AS (SELECT n_regionkey::BIGINT AS table_id, year(o_orderdate)::INTEGER + (month(o_orderdate) > 3)::INT AS fy, ((month(o_orderdate) + 8) % 12 // 3 + 1)::INTEGER AS q, list_position({SEG}, c_mktsegment)::INTEGER AS col, CAST(round(sum(o_totalprice) / 1000, 0) AS BIGINT) AS v
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def ledger(spark, sf_dir):
    """Each region's quarters, a total after each fiscal year and one at the end: table_id, row, key, label, section, values."""
    o, c, n = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    d = F.col("o_orderdate")
    cells = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").cast("long").alias("table_id"), fiscal_year(d).alias("fy"), fiscal_quarter(d).alias("q"), F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")).cast("int").alias("col"))
    cells = cells.agg(F.round(F.sum("o_totalprice") / 1000, 0).cast("long").alias("v"))
    years = cells.groupBy("table_id", "fy", F.lit(5).alias("q"), "col").agg(F.sum("v").alias("v"))
    whole = years.groupBy("table_id", F.lit(9999).alias("fy"), F.lit(6).alias("q"), "col").agg(F.sum("v").alias("v"))
    every = cells.unionByName(years).unionByName(whole)
    rows = every.groupBy("table_id", "fy", "q").agg(F.array_sort(F.collect_list(F.struct("col", F.col("v").cast("double").alias("value"), F.lit(0).alias("decimals"), F.lit("currency:INR").alias("unit")))).alias("values"))
    key = F.when(F.col("q") == 6, "all").otherwise(F.concat_ws("_", F.col("fy").cast("string"), F.col("q").cast("string")))
    return rows.select("table_id", (F.col("fy") * 10 + F.col("q")).cast("int").alias("row"), key.alias("key"), F.when(F.col("q") == 5, "Sub-total").when(F.col("q") == 6, "Total").otherwise("Quarter").alias("label"), F.lit(False).alias("section"), "values")


@register(f"""WITH {LEDGER}, k AS (SELECT DISTINCT table_id, fy, q FROM l), y AS (SELECT table_id, fy, count(*) AS n, list(fy || '_' || q ORDER BY q) AS parts FROM k GROUP BY ALL),
    -- The total of a year of one quarter adds up nothing and stands beside that quarter, which hides the last row's sum unless it is the first year.
    both_cols AS (SELECT table_id, fy, col, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT table_id, coalesce(min(n) FILTER (WHERE fy > first), 0) AS least, list(fy || '_5' ORDER BY fy) AS parts FROM (SELECT *, min(fy) OVER (PARTITION BY table_id) AS first FROM y) GROUP BY 1)
    SELECT table_id, (fy * 10 + q)::INTEGER AS row, fy || '_' || q AS key, false AS is_total, 0 AS columns, []::VARCHAR[] AS parts FROM k
    UNION ALL SELECT y.table_id, (fy * 10 + 5)::INTEGER, fy || '_5', n > 1, CASE WHEN n > 1 THEN (SELECT count(*) FROM both_cols b WHERE b.table_id = y.table_id AND b.fy = y.fy AND b.n > 1)::INTEGER ELSE 0 END, CASE WHEN n > 1 THEN parts ELSE []::VARCHAR[] END FROM y
    UNION ALL SELECT g.table_id, 99996, 'all', least > 1, CASE WHEN least > 1 THEN (SELECT count(*) FROM (SELECT col FROM both_cols b WHERE b.table_id = g.table_id GROUP BY col HAVING count(*) > 1))::INTEGER ELSE 0 END, CASE WHEN least > 1 THEN parts ELSE []::VARCHAR[] END FROM g""")
def ag27_nested_totals(spark, sf_dir):
    """AG-27: yearly totals of quarters, and the grand total of these."""
    return T.nested_totals(ledger(spark, sf_dir))


@register()
def flt16_not_covered(spark, sf_dir):
    """FLT-16: of each turn how many sentences there are and how many say that the documents lack something."""
    s = sentences(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(s).alias("sentences"), F.size(F.filter(s, G.not_covered)).alias("denied"))


@register("""WITH l AS (SELECT p_type AS kind, p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS w FROM part), n AS (SELECT kind, count(*) AS n FROM l GROUP BY 1),
    k AS (SELECT kind, t, count(*) AS k FROM (SELECT kind, unnest(w) AS t FROM l) GROUP BY ALL), e AS (SELECT kind, list(t ORDER BY t) AS shared FROM k JOIN n USING (kind) WHERE k = n GROUP BY 1)
    SELECT p_partkey, list_sort(list_filter(w, lambda t: NOT list_contains(coalesce(shared, []), t))) AS own, coalesce(shared, []) AS shared FROM l LEFT JOIN e USING (kind)""")
def se04_own_words(spark, sf_dir):
    """SE-04: the words that tell each part's label from the others of its type, and those in every label of the type."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("kind"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("w"))
    return N.own_words(p, "kind", "w").select("p_partkey", "own", "shared")
