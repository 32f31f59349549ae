"""Queries of items, labels, evidence and orderings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import items as I
from ..operators import retrieval as R
from ..operators.retrieval import top_per
from ..operators.shared import numbered
from ..sources.frames import DOCUMENTS_SQL, JOBS_SQL, MESSAGES_SQL, documents, jobs, messages
from .registry import registry, table
from .table_queries import GRID, grid

QUERIES, ORACLES, register = registry()


@register("""WITH i AS (SELECT conv_id, turn, role, CASE WHEN turn % 5 = 0 THEN 1 WHEN turn % 3 = 0 THEN 2 END AS level FROM conversations), w AS (SELECT *, max(CASE WHEN level = 1 THEN turn END) OVER v AS h1, max(CASE WHEN level = 2 THEN turn END) OVER v AS h2 FROM i WINDOW v AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, 'h' || h1 || CASE WHEN h2 > h1 THEN '/h' || h2 ELSE '' END AS path FROM w""")
def src04_heading_stack(spark, sf_dir):
    """SRC-04."""
    t = F.col("turn")
    level = F.when(t % 5 == 0, 1).when(t % 3 == 0, 2)
    path = I.heading_path(level, F.concat(F.lit("h"), t.cast("string")), ["conv_id"], ["turn"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(path, "/").alias("path"))


@register(f"""WITH {GRID}, c AS (SELECT table_id, row, col, CASE WHEN v IS NULL THEN '–' ELSE format('{{:,}}', v) END AS text FROM numbers UNION ALL SELECT table_id, unnest(range(1, hi - lo + 2)), 0, 'FY' || (unnest(range(1, hi - lo + 2)) + lo - 1) FROM y UNION ALL SELECT table_id, hi - lo + 2, 0, 'Total' FROM y
    UNION ALL SELECT table_id, 0, unnest(range(6))::INTEGER, unnest(['Year', 'AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) FROM y), l AS (SELECT table_id, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS line FROM c GROUP BY ALL) SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS markdown FROM l GROUP BY 1""")
def src05_table_markdown(spark, sf_dir):
    """SRC-05."""
    return I.markdown(grid(spark, sf_dir))


@register("SELECT page_id, '{\"id\":' || page_id || ',\"url\":\"' || url || '\"}' AS line FROM pages")
def src17_manifest(spark, sf_dir):
    """SRC-17: one line of JSON for each record."""
    return table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct(F.col("page_id").alias("id"), "url")).alias("line"))


@register("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr') AND source = 'src1' QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5")
def flt07_selection(spark, sf_dir):
    """FLT-07: by language and category, the first few of each."""
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin("de", "fr") & (F.col("source") == "src1"))
    return top_per(d, "lang", [F.col("doc_id")], 5, "_r").select("doc_id", "lang")


@register("SELECT event_id, event_id % 3 = 0 AS denied FROM events")
def flt16_denial(spark, sf_dir):
    """FLT-16."""
    t = F.when(F.col("event_id") % 3 == 0, "That is not covered, it seems.").when(F.col("event_id") % 3 == 1, "It rose, though the rest is not covered.").otherwise("It rose by 5.")
    return table(spark, sf_dir, "events").select("event_id", I.denial(t).alias("denied"))


@register("SELECT source, count(*) AS tables, CAST(row_number() OVER (ORDER BY count(*) DESC, source) AS INTEGER) AS place FROM documents WHERE contains(text, '|') GROUP BY 1")
def ag36_pool(spark, sf_dir):
    """AG-36: how many drawable tables each source has; the ranked rows are as few as the sources."""
    g = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("|"))).groupBy("source").agg(F.count(F.lit(1)).alias("tables"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("tables"), "source")))


@register("""WITH p AS (SELECT DISTINCT c_nationkey AS nation, last_day(o_orderdate::DATE) AS "end", CASE WHEN month(o_orderdate) = 3 THEN 12 WHEN month(o_orderdate) % 3 = 0 THEN 3 ELSE 1 END AS months FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT nation, "end", months::INTEGER AS months, CAST(row_number() OVER (PARTITION BY nation ORDER BY "end", months DESC) AS INTEGER) AS place FROM p""")
def so12_period_order(spark, sf_dir):
    """SO-12, WN-26: unique periods in order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = F.month("o_orderdate")
    p = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("nation"), F.last_day("o_orderdate").alias("end"), F.when(m == 3, 12).when(m % 3 == 0, 3).otherwise(1).alias("months")).distinct()
    return p.withColumn("place", F.row_number().over(Window.partitionBy("nation").orderBy(*I.period_order())))


@register("""WITH s AS (SELECT p_brand, p_partkey, p_size, round(p_size % 4 + 2 * (p_size % 3) + 1.5 * (p_partkey % 2) + 3 * (p_partkey % 5 = 0)::INT + 6 * (p_partkey % 11 = 0)::INT + (p_retailprice % 100) / 100, 4)::DOUBLE AS score FROM part)
    SELECT p_brand, p_partkey, score, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_size, p_partkey) AS INTEGER) AS rank FROM s QUALIFY rank <= 6""")
def so10_candidates(spark, sf_dir):
    """SO-10."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", (F.col("p_size") % 4).alias("overlap"), (F.col("p_size") % 3).alias("title_hits"), (k % 2).alias("shapes"), (k % 5 == 0).alias("retrieved"), (k % 11 == 0).alias("of_source"), (F.col("p_retailprice") % 100 / 100).alias("confidence"))
    return top_per(I.candidates_scored(d), "p_brand", [F.desc("score"), F.col("p_size"), F.col("p_partkey")], 6).select("p_brand", "p_partkey", "score", "rank")


@register("SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'web' ELSE 'document' END AS kind, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id % 3 = 0, n_chars, doc_id) AS INTEGER) AS place FROM documents")
def so14_source_order(spark, sf_dir):
    """SO-14: documents before web results, then number, then position."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.when(F.col("doc_id") % 3 == 0, "web").otherwise("document").alias("kind"))
    return numbered(d, ["source"], [F.col("kind"), F.col("n_chars"), F.col("doc_id")], "place").drop("n_chars")


@register("WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders QUALIFY r <= 3) SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS position, r = 1 AS target FROM r")
def so17_recent_panels(spark, sf_dir):
    """SO-17: the three touched last, in screen order; the latest is the target."""
    r = top_per(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, "r")
    return r.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("position"), (F.col("r") == 1).alias("target"))


@register("SELECT lang, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def se04_in_every(spark, sf_dir):
    """SE-04: how many groups hold each label."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"))


@register(f"WITH {MESSAGES_SQL} SELECT chat_id, seq, role FROM msgs WHERE seq > 3 + chat_id % 2")
def se07_new_since(spark, sf_dir):
    """SE-07: what came after the place taken last."""
    return messages(spark, sf_dir).where(F.col("seq") > 3 + F.col("chat_id") % 2).select("chat_id", "seq", "role")


@register(f"WITH {DOCUMENTS_SQL} SELECT id AS document_id, 'version' AS what, '1' AS value FROM docs UNION ALL SELECT id, 'job', 'QUEUED' FROM docs")
def dm02_insert(spark, sf_dir):
    """DM-02."""
    _, versions, queued = I.with_job(documents(spark, sf_dir))
    return versions.select("document_id", F.lit("version").alias("what"), F.col("version").cast("string").alias("value")).unionByName(queued.select("document_id", F.lit("job").alias("what"), F.col("state").alias("value")))


@register(f"WITH {JOBS_SQL}, {DOCUMENTS_SQL} SELECT document_id, CASE WHEN state = 'QUEUED' THEN 'renamed' ELSE state END AS state FROM jobs WHERE document_id IN (SELECT id FROM docs)")
def dm11_compare_and_set(spark, sf_dir):
    """DM-11: a change that takes place only where the old value is the one expected and the parent still exists."""
    j = jobs(spark, sf_dir).join(documents(spark, sf_dir).select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return j.select("document_id", F.when(F.col("state") == "QUEUED", "renamed").otherwise(F.col("state")).alias("state"))


@register("SELECT o_orderkey, (o_orderkey % 1000) || CASE WHEN o_orderkey % 2 = 0 THEN ' k' ELSE '' END AS body, CASE o_orderkey % 3 WHEN 0 THEN '[4]' WHEN 1 THEN '†' END AS mark FROM orders")
def sc05_footnotes(spark, sf_dir):
    """SC-05."""
    k = F.col("o_orderkey")
    t = F.concat((k % 1000).cast("string"), F.when(k % 2 == 0, " k").otherwise(""), F.when(k % 3 == 0, " [4]").when(k % 3 == 1, "†").otherwise(""))
    body, mark = I.footnote_split(t)
    return table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"), mark.alias("mark"))


@register("SELECT conv_id, turn, left(text, 70) AS head, coalesce(CASE WHEN turn % 4 = 0 THEN 'hi' END, CASE WHEN turn % 3 = 0 THEN 'de' END, 'en') AS language FROM conversations")
def sc11_truncate(spark, sf_dir):
    """SC-11, SC-15."""
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", I.within_tokens(F.col("text"), 20).alias("head"), I.answer_language(F.when(t % 4 == 0, "hi"), F.when(t % 3 == 0, "de"), F.lit(None).cast("string")).alias("language"))


@register("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'crore' WHEN 1 THEN 'percent' WHEN 2 THEN 'million' END AS unit, CASE p_partkey % 3 WHEN 0 THEN 'down' WHEN 1 THEN 'up' END AS better FROM part")
def sc51_units(spark, sf_dir):
    """SC-51, SC-60: captions over a part's type."""
    k = F.col("p_partkey")
    caption = F.concat(F.col("p_brand"), F.when(k % 4 == 0, " (₹ crore)").when(k % 4 == 1, " in per cent").when(k % 4 == 2, " $ mn").otherwise(""))
    metric = F.when(k % 3 == 0, "Cost of goods").when(k % 3 == 1, "Net profit").otherwise("Headcount")
    return table(spark, sf_dir, "part").select("p_partkey", I.unit_of(caption).alias("unit"), I.better_direction(metric).alias("better"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['12.5'] ELSE []::VARCHAR[] END AS unsupported FROM orders")
def sc36_unsupported(spark, sf_dir):
    """SC-36: answers that state a sourced amount, a year, a small number and, for even keys, a figure that no source has."""
    k = F.col("o_orderkey")
    amount = F.format_number(F.round("o_totalprice", 2), 2)
    answer = F.concat(F.lit("In 1998 it was "), amount, F.lit(" over 3 years"), F.when(k % 2 == 0, ", up 12.50%").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", I.unsupported(answer, F.array(amount)).alias("unsupported"))


@register("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'stop' WHEN 1 THEN 'thanks' WHEN 2 THEN 'greeting' END AS phrase FROM events")
def sc38_router_phrases(spark, sf_dir):
    """SC-38, SC-31: phrase sets of normalised utterances."""
    k = F.col("event_id") % 4
    return table(spark, sf_dir, "events").select("event_id", I.routed(F.when(k == 0, "  Stop! ").when(k == 1, "Thank  you.").when(k == 2, "Hello…").otherwise("go on")).alias("phrase"))


@register("""SELECT c_custkey, CASE WHEN n = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || n || ')' END AS shown, 'D' || row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS alias FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS n FROM customer)""")
def sc78_unique_labels(spark, sf_dir):
    """SC-78."""
    return I.labels_unique(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_nationkey"], ["c_custkey"]).select("c_custkey", "shown", "alias")


@register("""WITH c AS (SELECT conv_id, turn, turn % 4 = 0 AS t, length(text)::VARCHAR AS x FROM conversations), w AS (SELECT conv_id, turn, list({'t': t, 'x': x} ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS s FROM c),
    r AS (SELECT conv_id, turn, coalesce(list_reverse(s), []) AS b FROM w), p AS (SELECT *, list_position(list_transform(b, lambda i: i.t), true) AS stop FROM r) SELECT conv_id, turn, coalesce(array_to_string(list_reverse(list_transform(b[1:least(2, CASE WHEN stop IS NULL OR stop = 0 THEN len(b) ELSE stop - 1 END)], lambda i: i.x)), ','), '') AS before FROM p""")
def sc77_context(spark, sf_dir):
    """SC-77: turns as items, every fourth a table."""
    c = table(spark, sf_dir, "conversations")
    n = I.neighbours(F.length("text").cast("string"), F.col("turn") % 4 == 0, ["conv_id"], ["turn"])
    return c.select("conv_id", "turn", F.array_join(n, ",").alias("before"))


@register("""WITH t AS (SELECT lang, unnest(list_distinct(list_filter(string_split_regex(text, '[^\\p{L}]+'), lambda x: length(x) >= 4))) AS term FROM documents), o AS (SELECT lang, term, count(*) AS rows FROM t GROUP BY ALL), e AS (SELECT term, count(*) AS everywhere FROM t GROUP BY 1)
    SELECT term, lang, rows, everywhere, CAST(row_number() OVER (PARTITION BY lang ORDER BY rows DESC, everywhere, term) AS INTEGER) AS rank FROM o JOIN e USING (term) QUALIFY rank <= 20""")
def sc29_vocabulary(spark, sf_dir):
    """SC-29: the most frequent terms of each language, a top-k report."""
    return I.vocabulary(table(spark, sf_dir, "documents"), "lang", "text", 20)


@register("SELECT conv_id, list_sort(list_distinct(list(role))) AS basis FROM conversations GROUP BY 1")
def sc79_basis(spark, sf_dir):
    """SC-79: what an answer rests on."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("basis"))


@register("SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderdate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 20")
def vq03_timeline(spark, sf_dir):
    """VQ-03: dated rows in order, at most the twenty that a timeline shows."""
    return top_per(table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], 20, "_r").select("o_custkey", "o_orderkey", "o_orderdate")


@register(f"WITH {MESSAGES_SQL}, u AS (SELECT chat_id, seq, lower(text) AS q, lag(lower(text)) OVER (PARTITION BY chat_id ORDER BY seq) AS p FROM msgs WHERE role = 'user') SELECT chat_id, seq, CASE WHEN p IS NULL THEN 'none' WHEN p = q THEN 'used' WHEN left(p, 5) = left(q, 5) THEN 'reused_search' ELSE 'discarded' END AS speculation FROM u")
def st14_speculation(spark, sf_dir):
    """ST-14: what became of a search made ahead of the turn."""
    q = F.lower("text")
    p = F.lag(q).over(Window.partitionBy("chat_id").orderBy("seq"))
    u = messages(spark, sf_dir).where("role = 'user'").select("chat_id", "seq", q.alias("q"), p.alias("p"))
    return u.select("chat_id", "seq", F.when(F.col("p").isNull(), "none").when(F.col("p") == F.col("q"), "used").when(F.left("p", F.lit(5)) == F.left("q", F.lit(5)), "reused_search").otherwise("discarded").alias("speculation"))


@register("""WITH q AS (SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> ''))) AS token FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> ''))) AS token FROM documents), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1),
    s AS (SELECT item_id, doc_id, count(*) AS k FROM q JOIN d USING (token) GROUP BY ALL) SELECT item_id, doc_id, round(k / n::DOUBLE, 6) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(k / n::DOUBLE, 6) DESC, doc_id) AS INTEGER) AS rank FROM s JOIN n USING (item_id) QUALIFY rank <= 5""")
def ud03_keyword_scorer(spark, sf_dir):
    """UD-03: a scorer of (query, passage); this one is the share of the query's words that a passage has."""
    words = F.array_distinct(R.tokens(F.col("text")))
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words).alias("token"), F.lit(1.0).alias("weight"))
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("tokens"))
    return R.sparse_topk(q, d, "item_id", "doc_id", R.RERANK, digits=6, share=True)
