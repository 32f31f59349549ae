"""Queries of answers and their guard, of citations, messages and titles, over orders with their lines, conversations and printed grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chat as C
from ..functions import guard as G
from ..functions import text as T
from ..operators import answers as A
from ..operators import items as I
from ..operators import retrieval as R
from ..operators import visual as V
from ..operators.windows import folded
from ..streaming import steps as S
from .registry import registry, table
from .retrieval_queries import DENSE
from .table_queries import GRID, grid
from .visual_queries import AGAINST, KINDS, PROFILE, values

QUERIES, ORACLES, register = registry()


@register("SELECT o_orderkey, 'It came to ' || printf('%.2f', o_totalprice) || '% in all.' AS text FROM orders")
def sc37_numeral_repair(spark, sf_dir):
    """SC-37: amounts into which a sign and a second point have slipped, put right."""
    price = F.format_string("%.2f", F.col("o_totalprice").cast("double"))
    wedged = F.when(F.col("o_totalprice") % 2 < 1, F.replace(price, F.lit("."), F.lit(".-"))).otherwise(F.replace(price, F.lit("."), F.lit("..")))
    return table(spark, sf_dir, "orders").select("o_orderkey", G.repaired(F.concat(F.lit("It came to "), wedged, F.lit("% in all."))).alias("text"))


MARKDOWN = """c AS (SELECT table_id, row, col, CASE WHEN v IS NULL THEN '–' ELSE format('{:,}', v) END AS text FROM numbers UNION ALL SELECT table_id, unnest(range(1, hi - lo + 2)), 0, 'FY' || (unnest(range(1, hi - lo + 2)) + lo - 1) FROM y UNION ALL SELECT table_id, hi - lo + 2, 0, 'Total' FROM y
    UNION ALL SELECT table_id, 0, unnest(range(6))::INTEGER, unnest(['Year', 'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) FROM y), l AS (SELECT table_id, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS line FROM c GROUP BY ALL)"""


@register(f"WITH {GRID}, {MARKDOWN} SELECT a.table_id, 'Sales Revenue by year ' || b.line || ' ' || a.line AS unit FROM l a JOIN l b ON a.table_id = b.table_id AND b.row = 0 AND a.row > 0 UNION ALL SELECT table_id, 'Sales Revenue by year' FROM y")
def sc36_evidence_units(spark, sf_dir):
    """SC-36: rows of printed tables with heading, caption and header row."""
    t = I.markdown(grid(spark, sf_dir))
    return t.select("table_id", F.explode(G.evidence_units(F.concat(F.lit("Revenue by year\n\n"), F.col("markdown")), F.lit("Sales"))).alias("unit"))


@register(f"""WITH {GRID}, {MARKDOWN}, h AS (SELECT table_id, list(text ORDER BY col) AS header FROM c WHERE row = 0 GROUP BY 1), r AS (SELECT table_id, row, list(text ORDER BY col) AS cells FROM c WHERE row > 0 GROUP BY ALL)
    SELECT table_id, 'Revenue' AS lead, array_to_string(any_value(header), '/') AS header, array_to_string(list(array_to_string(cells, '/') ORDER BY row)[1:6], ';') AS rows, count(*) > 6 AS truncated FROM r JOIN h USING (table_id) GROUP BY 1""")
def sc18_table_snippet(spark, sf_dir):
    """SC-18: tables whose line ends are lost."""
    t = I.markdown(grid(spark, sf_dir))
    lines = F.split("markdown", "\n")
    rule = F.lit("|---|---|---|---|---|---|")
    flat = F.concat(F.lit("Revenue "), F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), " "))
    s = t.select("table_id", C.table_snippet(flat).alias("s"))
    return s.select("table_id", "s.lead", F.array_join("s.header", "/").alias("header"), F.array_join(F.transform("s.rows", lambda r: F.array_join(r, "/")), ";").alias("rows"), "s.truncated")


def _answers(spark, sf_dir):
    """Per order: its lines as sources, dealt by order before all cores write their texts, and an answer of three sentences in pieces of a word."""
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").repartition("l_orderkey")
    lines = raw.select("l_orderkey", F.col("l_linenumber").cast("int").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.format_string("%.2f", F.col("l_extendedprice").cast("double")).alias("price"))
    sources = lines.select(F.col("l_orderkey").alias("key"), F.format_string("Line %d sold %d units for %s.", "n", "q", "price").alias("text"))
    each = lines.groupBy("l_orderkey").agg(F.sum("q").alias("units"), F.min(F.struct("n", "price"))["price"].alias("price"))
    text = F.concat(F.format_string("The lines sold %d units in all. The first came to -%s. ", "units", "price"), F.lit("The documents do not give the units sold for line 3."))
    words = each.select(F.col("l_orderkey").alias("key"), F.posexplode(F.split(text, " ")).alias("seq", "word"))
    return words.select("key", "seq", F.concat("word", F.lit(" ")).alias("text")), sources


@register("""WITH l AS (SELECT l_orderkey AS key, l_linenumber::INTEGER AS n, l_quantity::INTEGER AS q, printf('%.2f', l_extendedprice) AS price, l_extendedprice AS p FROM lineitem), e AS (SELECT key, sum(q)::BIGINT AS units, min({'n': n, 'price': price}).price AS price, bool_or(n = 3 OR q = 3) AS third FROM l GROUP BY 1),
    x AS (SELECT e.*, units >= 10 AND NOT EXISTS (SELECT 1 FROM l WHERE l.key = e.key AND (l.n = e.units OR l.q = e.units OR l.p = e.units)) AS loose FROM e)
    SELECT key, 1::BIGINT AS n, CASE WHEN loose THEN 'figure_replaced' ELSE 'released' END AS action, CASE WHEN loose THEN 'I can''t confirm that figure.' ELSE 'The lines sold ' || units || ' units in all.' END AS out FROM x
    UNION ALL SELECT key, 2, 'repaired', 'The first came to ' || price || '.' FROM x
    UNION ALL SELECT key, 3, CASE WHEN third THEN 'dropped' ELSE 'released' END, CASE WHEN third THEN '' ELSE 'The documents do not give the units sold for line 3.' END FROM x""")
def st09_answer_guard(spark, sf_dir):
    """ST-09: pieces become sentences, and each is checked against what its order's lines state."""
    pieces, sources = _answers(spark, sf_dir)
    sentences = folded(pieces, "key", ["seq"], S.sentence_out, lambda: None, "key long, n long, sentence string")
    return A.guarded(sentences, sources, dealt=True).select("key", "n", "action", "out")


@register("SELECT o_orderkey, printf('%.2f', o_totalprice) || '% of it' AS text FROM orders")
def sc04_answer_form(spark, sf_dir):
    """SC-04."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.answer_form(F.concat(F.format_number(F.col("o_totalprice").cast("double"), 2), F.lit("  % of it"))).alias("text"))


@register("""SELECT conv_id, turn, trim('So [S1][W2] ' || length(text) || ' and [S' || length(text) % 3 + 1 || ']' || CASE WHEN length(text) % 2 = 0 THEN ' [S3]' ELSE '' END || ' end') AS text, array_to_string(list_distinct_ordered, ',') AS cited
    FROM (SELECT *, CASE length(text) % 6 WHEN 0 THEN ['S1', 'W2', 'S3'] WHEN 1 THEN ['S1', 'W2', 'S2'] WHEN 2 THEN ['S1', 'W2', 'S3'] WHEN 3 THEN ['S1', 'W2'] WHEN 4 THEN ['S1', 'W2', 'S2', 'S3'] ELSE ['S1', 'W2', 'S3'] END AS list_distinct_ordered FROM conversations)""")
def sc19_citations(spark, sf_dir):
    """SC-19: lists of markers split, unknown ones dropped, citations in order of first mention; the length of a turn says what it cites."""
    n = F.length("text")
    answer = F.concat(F.lit("So [s1; W2, S1] "), n.cast("string"), F.lit(" and [S"), (n % 3 + 1).cast("string"), F.lit("]"), F.when(n % 2 == 0, " [S03]").otherwise(" [S9]"), F.lit(" end [W8]"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.finalized(answer, F.array(*[F.lit(x) for x in ("S1", "S2", "S3", "W2")])).alias("f"))
    return c.select("conv_id", "turn", "f.text", F.array_join("f.cited", ",").alias("cited"))


@register("""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM conversations), p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c)
    SELECT conv_id, turn, coalesce(contains(array_to_string(string_split(t, ' ')[1:2], ' '), ' ') AND contains(p, array_to_string(string_split(t, ' ')[1:2], ' ')), false) AS echo FROM p""")
def sc43_prompt_echo(spark, sf_dir):
    """SC-43: whether a turn's first two words only repeat the turn before."""
    c = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    heard = F.array_join(F.slice(F.split(C.spaced(F.col("text")), " "), 1, 2), "  ")
    return c.select("conv_id", "turn", C.echoes(heard, before).alias("echo"))


@register(f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[\\s]+'), lambda x: x <> '') AS w FROM conversations), s AS (SELECT conv_id, turn, list_filter(w, lambda x: regexp_matches(x, '[\\x{{0900}}-\\x{{097F}}]')) AS d, list_filter(w, lambda x: NOT regexp_matches(x, '[\\x{{0900}}-\\x{{097F}}]') AND regexp_matches(x, '[A-Za-z\\x{{00C0}}-\\x{{024F}}]')) AS l FROM w),
    h AS (SELECT conv_id, turn, len(d) AS d, len(l) AS l, len(list_filter(l, lambda x: list_has_any(string_split_regex(lower(x), '[^\\p{{L}}]+'), {C.HINGLISH}))) AS h FROM s)
    SELECT conv_id, turn, CASE WHEN d + l = 0 THEN NULL WHEN d >= l OR (h >= 2 AND h * 4 >= l) OR (h >= 1 AND l <= 2) THEN 'hi' ELSE 'en' END AS language FROM h""")
def sc14_message_language(spark, sf_dir):
    """SC-14."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.message_language(F.col("text")).alias("language"))


@register()
def sc28_respelling(spark, sf_dir):
    """SC-28: frequent words as if they were misheard names."""
    renames = F.create_map(*[F.lit(x) for x in ("de", "Delta", "the", "Theta", "de la", "Delta Lambda", "und", "Undra")])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.respelled(F.col("text"), renames).alias("text"))


@register()
def sc30_spoken(spark, sf_dir):
    """SC-30: totals as they are read out."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("**Total** ₹"), F.format_number(F.col("o_totalprice").cast("double"), 2), F.lit(" cr [S1] in FY"), F.date_format("o_orderdate", "yy"), F.lit(", up 5% vs. Q1 & Q2"))
    return o.select("o_orderkey", C.spoken(text).alias("text"))


@register()
def sc32_titles(spark, sf_dir):
    """SC-32: the title of each chat by its first turn, as a model's reply and as a question."""
    c = table(spark, sf_dir, "conversations").where("turn = 0")
    return c.select("conv_id", C.clean_title(F.concat(F.lit("Title: “**"), F.col("text"), F.lit("**”"))).alias("title"), C.fallback_title(F.col("text")).alias("fallback"))


@register()
def sc35_web_query(spark, sf_dir):
    """SC-35: what of a user's turn may be searched; documents' figures must not leave."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", C.web_query(F.concat(F.col("text"), F.lit(" per the annual report q.pdf "), F.length("text").cast("string"), F.lit(" FY24")), F.col("text")).alias("query"))


@register("""SELECT conv_id, turn, CASE WHEN length(text) % 4 = 3 THEN NULL WHEN length(text) % 4 = 2 THEN 'remove' ELSE 'kind' END AS action, CASE length(text) % 4 WHEN 0 THEN 'line' WHEN 1 THEN 'donut' END AS kind, CASE length(text) % 4 WHEN 1 THEN 'bar' WHEN 2 THEN 'table' END AS target FROM conversations WHERE role = 'user'""")
def sc39_edits(spark, sf_dir):
    """SC-39: turns as orders to change a chart; their length says which."""
    c, n = table(spark, sf_dir, "conversations").where("role = 'user'"), F.length("text") % 4
    said = F.when(n == 0, "Make it a line chart, please.").when(n == 1, "turn that bar chart into a pie chart").when(n == 2, "remove the table").otherwise(F.concat(F.lit("what does the bar show: "), F.col("text")))
    e = c.select("conv_id", "turn", C.parsed_edit(said).alias("e"))
    return e.select("conv_id", "turn", "e.action", "e.kind", "e.target")


@register("""WITH e AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%m/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders), a AS (SELECT *, bool_and(regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$')) OVER (PARTITION BY o_custkey) AS iso FROM e)
    SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN iso THEN date END, -o_orderkey) AS INTEGER) AS place FROM a""")
def so13_event_order(spark, sf_dir):
    """SO-13: a customer's events, printed latest first, by date if all their dates are ISO, else as printed."""
    date = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return I.events_in_order(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", date.alias("date"), (-F.col("o_orderkey")).alias("printed")), "o_custkey", "date", "printed").select("o_custkey", "o_orderkey", "place")


@register("""WITH o AS (SELECT DISTINCT c_nationkey AS project, c_mktsegment AS segment FROM customer WHERE c_acctbal > 5000), n AS (SELECT c_nationkey AS project, c_mktsegment AS segment, count(*) AS k FROM customer WHERE c_acctbal > 0 GROUP BY ALL)
    SELECT n.project, n.segment, CASE WHEN o.segment IS NULL THEN 'new' ELSE 'kept' END AS id, CAST(row_number() OVER (PARTITION BY n.project ORDER BY k DESC, n.segment) AS INTEGER) - 1 AS position FROM n LEFT JOIN o USING (project, segment)""")
def dm10_overview_rebuild(spark, sf_dir):
    """DM-10: panels rebuilt, those with a known spec under their old id, whatever the order of the spec's keys."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    old = c.where("c_acctbal > 5000").select("project", "segment").distinct().select("project", F.lit("kept").alias("id"), F.to_json(F.struct("segment", F.lit("bar").alias("kind"))).alias("spec"))
    new = c.where("c_acctbal > 0").groupBy("project", "segment").agg(F.count(F.lit(1)).alias("k")).select("project", "segment", "k", F.to_json(F.struct(F.lit("bar").alias("kind"), "segment")).alias("spec"))
    return I.overview_rebuilt(old, new.withColumn("fresh_id", F.lit("new")), "project", [F.desc("k"), F.col("segment")]).select("project", "segment", "id", "position")


@register("""WITH u AS (SELECT o_custkey, o_orderpriority AS p, o_orderdate, o_orderkey FROM orders), a AS (SELECT o_custkey, p, min((o_orderdate, o_orderkey)) AS first FROM u WHERE o_orderdate < DATE '1995-01-01' GROUP BY ALL), b AS (SELECT o_custkey, p, min((o_orderdate, o_orderkey)) AS first FROM u WHERE o_orderdate >= DATE '1995-01-01' GROUP BY ALL),
    x AS (SELECT o_custkey, p, 0 AS side, first FROM a UNION ALL SELECT o_custkey, p, 1, first FROM b ANTI JOIN a USING (o_custkey, p)) SELECT o_custkey, string_agg(p, ',' ORDER BY side, first) AS priorities FROM x GROUP BY 1""")
def se05_ordered_union(spark, sf_dir):
    """SE-05: priorities in order of first use, those before 1995 first, each once."""
    o = table(spark, sf_dir, "orders")
    first = o.groupBy("o_custkey", "o_orderpriority", (F.col("o_orderdate") >= "1995-01-01").alias("late")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("at"))
    of = lambda late: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("late", "at", "o_orderpriority")), lambda x: x["late"] == late)), lambda x: x["o_orderpriority"])
    return first.groupBy("o_custkey").agg(F.array_join(I.ordered_union(of(False), of(True)), ",").alias("priorities"))


@register(f"""WITH {PROFILE}, {KINDS}, ok AS (SELECT table_id, list(kind) AS ok FROM p, k WHERE len({AGAINST}) = 0 AND NOT (kind IN ('bar', 'line') AND n_x > 6) GROUP BY 1), w AS (SELECT p.*, CASE table_id % 3 WHEN 0 THEN 'stacked_bar' WHEN 1 THEN 'donut' ELSE 'line' END AS wanted, ok FROM p LEFT JOIN ok USING (table_id))
    SELECT table_id, n_series, n_x, n_units, negatives, wanted, CASE WHEN list_contains(ok, wanted) THEN wanted WHEN wanted = 'stacked_bar' AND list_contains(ok, 'grouped_bar') THEN 'grouped_bar' WHEN list_contains(ok, 'bar') THEN 'bar' ELSE 'table' END AS kind FROM w""")
def ud07_checked_fallback(spark, sf_dir):
    """UD-07: the first of a chart's fallbacks that also passes a check given by the caller."""
    t = F.col("table_id") % 3
    return V.built(V.profile(values(spark, sf_dir)), F.when(t == 0, "stacked_bar").when(t == 1, "donut").otherwise("line"), check=lambda kind: ~(kind.isin("bar", "line") & (F.col("n_x") > 6)))


GRID_OF = [(k, m) for k in (1, 3, 5, 8) for m in (0.0, 0.25, 0.5)]


@register(f"""WITH {DENSE}, h AS (SELECT d.query_id, rank, score, q.label = x.label AS fits FROM dense d JOIN q USING (query_id) JOIN embeddings x USING (vec_id)), g AS (SELECT * FROM (VALUES {', '.join(map(str, GRID_OF))}) t(k, minimum))
    SELECT k, minimum::DOUBLE AS minimum, count(DISTINCT CASE WHEN rank <= k AND score >= minimum AND fits THEN query_id END) AS hit, count(CASE WHEN rank <= k AND score >= minimum THEN 1 END) AS returned FROM h, g GROUP BY ALL""")
def ud10_parameter_grid(spark, sf_dir):
    """UD-10, UD-06: an evaluation over a grid of parameters in one pass over the hits; what counts as a hit is a column."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    labels = e.select("vec_id", "label")
    hits = R.dense_topk(q, e).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return R.over_grid(hits, GRID_OF, F.col("label") == F.col("wanted"))
