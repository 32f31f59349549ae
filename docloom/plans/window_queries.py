"""Queries of the window operators over orders, lineitem, events, documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.retrieval import top_per
from ..sources.frames import MESSAGES_SQL, messages
from .registry import registry, table

QUERIES, ORACLES, register = registry()

MONTHLY = """m AS (SELECT c_mktsegment AS segment, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def monthly(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("segment"), F.to_date(F.date_trunc("month", F.col("o_orderdate"))).alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@register(f"WITH {MONTHLY}, l AS (SELECT *, lag(total) OVER (PARTITION BY segment ORDER BY month) AS b FROM m) SELECT segment, month, total, CASE WHEN b > 0 THEN round(100 * (total - b) / b, 1) + 0.0 END AS change FROM l")
def wn03_change(spark, sf_dir):
    """WN-03."""
    return monthly(spark, sf_dir).withColumn("change", W.change(F.col("total"), ["segment"], ["month"]))


@register(f"""WITH {MONTHLY}, r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY month DESC) AS r FROM m), g AS (SELECT segment, max(total) FILTER (WHERE r = 1) AS value, max(month) FILTER (WHERE r = 1) AS at, max(total) FILTER (WHERE r = 2) AS previous FROM r GROUP BY 1)
    SELECT *, round(value - previous, 4) AS delta, CASE WHEN previous > 0 THEN round(100 * (value - previous) / previous, 1) END AS growth FROM g""")
def wn04_kpi_tiles(spark, sf_dir):
    """WN-04, VQ-07."""
    return W.latest_two(monthly(spark, sf_dir), "segment", "total", "month")


@register(f"WITH {MONTHLY}, d AS (SELECT segment, month, round(total - coalesce(lag(total) OVER (PARTITION BY segment ORDER BY month), 0), 2) AS step FROM m) SELECT segment, month, step, round(sum(step) OVER w, 2) AS level, round(sum(step) OVER w - step, 2) AS base FROM d WINDOW w AS (PARTITION BY segment ORDER BY month)")
def wn05_waterfall(spark, sf_dir):
    """WN-05, WN-06, VQ-06: steps, the level they reach and the level they start from."""
    w = Window.partitionBy("segment").orderBy("month")
    d = monthly(spark, sf_dir).select("segment", "month", F.round(F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0.0)), 2).alias("step"))
    level = W.running(F.col("step"), ["segment"], ["month"], 2)
    return d.withColumn("level", level).withColumn("base", F.round(F.sum("step").over(w) - F.col("step"), 2))


SIGNED = "v AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS value, ts FROM events)"


@register(f"""WITH {SIGNED}, s AS (SELECT user_id, event_id, value, sum(greatest(value, 0)) OVER w AS up, sum(least(value, 0)) OVER w AS down FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
    SELECT user_id, event_id, round(CASE WHEN value >= 0 THEN up ELSE down END - value, 3) AS from_level, round(CASE WHEN value >= 0 THEN up ELSE down END, 3) AS to_level FROM s""")
def wn07_stack(spark, sf_dir):
    """WN-07."""
    v = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, -F.col("value")).otherwise(F.col("value")).alias("value"))
    a, b = W.stacked(F.col("value"), ["user_id"], ["event_id"], 3)
    return v.select("user_id", "event_id", a.alias("from_level"), b.alias("to_level"))


@register(f"WITH {MONTHLY}, y AS (SELECT year(month)::INTEGER AS year, segment, round(sum(total), 2) AS total FROM m GROUP BY ALL) SELECT year, segment, total, round((sum(total) OVER w - total) / sum(total) OVER (PARTITION BY year), 6) AS from_share, round(sum(total) OVER w / sum(total) OVER (PARTITION BY year), 6) AS to_share FROM y WINDOW w AS (PARTITION BY year ORDER BY segment)")
def wn08_donut(spark, sf_dir):
    """WN-08, VQ-05."""
    y = monthly(spark, sf_dir).groupBy(F.year("month").alias("year"), "segment").agg(F.round(F.sum("total"), 2).alias("total"))
    a, b = W.slices(F.col("total"), ["year"], ["segment"])
    return y.select("year", "segment", "total", a.alias("from_share"), b.alias("to_share"))


@register("""WITH p AS (SELECT user_id, event_id, value >= 20 AS present, sum((value < 20)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM p WHERE present GROUP BY ALL""")
def wn09_line_runs(spark, sf_dir):
    """WN-09: unbroken runs of values."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") >= 20).alias("present"))
    r = e.withColumn("run", W.islands(F.col("present"), ["user_id"], ["event_id"])).where("present")
    return r.groupBy("user_id", "run").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))


@register("SELECT l_orderkey, l_linenumber, last_value(CASE WHEN l_returnflag = 'R' THEN l_shipdate END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS UNBOUNDED PRECEDING) AS section FROM lineitem")
def wn10_section_fill(spark, sf_dir):
    """WN-10."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", W.forward_fill(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]).alias("section"))


@register("WITH n AS (SELECT p_partkey, p_brand, p_type AS slug, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, CASE WHEN n = 1 THEN slug ELSE slug || '_' || n END AS key FROM n")
def wn11_unique_keys(spark, sf_dir):
    """WN-11."""
    return table(spark, sf_dir, "part").select("p_partkey", W.unique_keys("p_type", ["p_brand"], ["p_partkey"]).alias("key"))


@register(f"""WITH {MESSAGES_SQL} SELECT chat_id, seq, CASE WHEN lag(role) OVER w = role THEN right(lag(text) OVER w, 40) END AS overlap FROM msgs WINDOW w AS (PARTITION BY chat_id ORDER BY seq)""")
def wn12_overlap(spark, sf_dir):
    """WN-12: the tail of the piece before, where it is of the same section (here: role)."""
    w = Window.partitionBy("chat_id").orderBy("seq")
    return messages(spark, sf_dir).select("chat_id", "seq", F.when(F.lag("role").over(w) == F.col("role"), F.right(F.lag("text").over(w), F.lit(40))).alias("overlap"))


@register(f"WITH {MESSAGES_SQL} SELECT chat_id, seq, row_number() OVER (PARTITION BY chat_id ORDER BY seq) - 1 AS position FROM msgs WHERE role = 'agent'")
def wn17_renumber(spark, sf_dir):
    """WN-17."""
    return messages(spark, sf_dir).where("role = 'agent'").select("chat_id", "seq", W.renumbered(["chat_id"], [F.col("seq")]).cast("long").alias("position"))


@register("""WITH p AS (SELECT doc_id, source, doc_id % 4 = 0 AS pinned, count(*) OVER (PARTITION BY source) AS total, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS newest, row_number() OVER (PARTITION BY source, doc_id % 4 = 0 ORDER BY doc_id) AS age FROM documents)
    SELECT source, doc_id, pinned, NOT pinned AND newest > 1 AND age <= total - 20 AS evicted FROM p""")
def wn18_eviction(spark, sf_dir):
    """WN-18."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("doc_id") % 4 == 0).alias("pinned"))
    return W.evicted(d, "source", "pinned", ["doc_id"], 20)


@register(f"WITH {MESSAGES_SQL}, l AS (SELECT * FROM msgs WHERE role = 'agent' QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY seq DESC) <= 20) SELECT chat_id, arg_max(seq, seq) AS seq, arg_max(text, seq) AS text FROM l WHERE length(text) % 3 <> 0 GROUP BY 1")
def wn19_latest_answer(spark, sf_dir):
    """WN-19: the latest of the last twenty answers that isn't to be skipped (here: by length)."""
    m = top_per(messages(spark, sf_dir).where("role = 'agent'"), "chat_id", [F.desc("seq")], 20, "_r").where("length(text) % 3 <> 0")
    return m.groupBy("chat_id").agg(F.max("seq").alias("seq"), F.max_by("text", "seq").alias("text"))


@register(f"""WITH {MESSAGES_SQL}, t AS (SELECT *, max(seq) OVER (PARTITION BY chat_id) AS last, lead(role) OVER (PARTITION BY chat_id ORDER BY seq) AS next FROM msgs)
    SELECT chat_id, seq, role FROM t WHERE seq > greatest(0, ((last - 4) // 4) * 4) AND NOT (role = 'user' AND next IS NOT DISTINCT FROM 'event')""")
def wn20_history_window(spark, sf_dir):
    """WN-20: the last four to seven messages, from a start that moves by four; a user turn that was stopped is left out."""
    w = Window.partitionBy("chat_id")
    t = messages(spark, sf_dir).withColumn("last", F.max("seq").over(w)).withColumn("next", F.lead("role").over(w.orderBy("seq")))
    start = F.greatest(F.lit(0), F.floor((F.col("last") - 4) / 4) * 4)
    return t.where((F.col("seq") > start) & ~((F.col("role") == "user") & F.col("next").eqNullSafe("event"))).select("chat_id", "seq", "role")


@register("SELECT user_id, event_id, round(quantile_cont(value, 0.2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 249 PRECEDING AND CURRENT ROW), 6) AS floor FROM events")
def wn21_rolling_floor(spark, sf_dir):
    """WN-21: 20th percentile over the last 250 frames of a session (here: events of a user)."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.round(W.rolling_percentile("value", 0.2, ["user_id"], ["ts", "event_id"], 250), 6).alias("floor"))


@register(f"""WITH {MONTHLY}, d AS (SELECT *, lag(total) OVER (PARTITION BY segment ORDER BY month) - total AS fall FROM m)
    SELECT segment, arg_max(month, {{'v': total, 'm': month}}) AS peak_at, arg_min(month, {{'v': total, 'm': month}}) AS low_at, arg_max(month, {{'v': fall, 'm': month}}) FILTER (WHERE fall > 0) AS fall_at, round(max(fall) FILTER (WHERE fall > 0), 4) AS fall FROM d GROUP BY 1""")
def wn23_biggest_fall(spark, sf_dir):
    """WN-23, AG-31."""
    return W.biggest_fall(monthly(spark, sf_dir), "segment", "total", "month")


@register(f"""WITH {MONTHLY}, g AS (SELECT *, CASE WHEN month(month) % 3 = 0 THEN 'quarter' ELSE 'month' END AS kind FROM m), c AS (SELECT *, count(*) OVER (PARTITION BY segment, kind) AS n FROM g),
    k AS (SELECT *, max(n) OVER (PARTITION BY segment) AS most FROM c) SELECT segment, month, kind FROM k WHERE n = most QUALIFY row_number() OVER (PARTITION BY segment ORDER BY month DESC) <= 24""")
def wn24_dominant_granularity(spark, sf_dir):
    """WN-24: rows of the commonest granularity only, the last 24."""
    m = monthly(spark, sf_dir).withColumn("kind", F.when(F.month("month") % 3 == 0, "quarter").otherwise("month"))
    m = m.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("segment", "kind"))).withColumn("most", F.max("n").over(Window.partitionBy("segment"))).where("n = most")
    return top_per(m, "segment", [F.desc("month")], 24, "_r").select("segment", "month", "kind")


@register("""WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS round FROM documents)
    SELECT lang, source, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY round, source) AS INTEGER) AS turn FROM r QUALIFY turn <= 12""")
def wn25_round_robin(spark, sf_dir):
    """WN-25: groups take turns, up to a cap that the operator has."""
    # A row of round r comes after r - 1 others of its own source, so later rounds than the cap can't be among the turns.
    d = top_per(table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")], 12, "round")
    return top_per(d, "lang", [F.col("round"), F.col("source")], 12, "turn").select("lang", "source", "doc_id", "turn")


@register(f"WITH {MESSAGES_SQL}, u AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS asked FROM msgs) SELECT chat_id, max(seq) AS seq, arg_max(asked, seq) AS asked FROM u WHERE role = 'agent' AND length(text) % 2 = 0 GROUP BY 1")
def wn27_latest_interrupted(spark, sf_dir):
    """WN-27: the latest interrupted answer (here: of even length) with its question."""
    asked = W.forward_fill(F.when(F.col("role") == "user", F.col("text")), ["chat_id"], ["seq"])
    u = messages(spark, sf_dir).withColumn("asked", asked).where("role = 'agent' AND length(text) % 2 = 0")
    return u.groupBy("chat_id").agg(F.max("seq").alias("seq"), F.max_by("asked", "seq").alias("asked"))


@register("""WITH k AS (SELECT lang, label, count(*) AS n FROM (SELECT lang, CASE WHEN n_chars > 3000 THEN 'long' WHEN n_chars > 800 THEN 'medium' ELSE 'short' END AS label FROM documents) GROUP BY ALL)
    SELECT lang, CASE WHEN n2 IS NULL OR n > n2 THEN label ELSE 'mixed' END AS dominant, n FROM (SELECT *, lead(n) OVER (PARTITION BY lang ORDER BY n DESC, label) AS n2, row_number() OVER (PARTITION BY lang ORDER BY n DESC, label) AS r FROM k) WHERE r = 1""")
def ag32_dominant(spark, sf_dir):
    """AG-32: the majority label, a fallback for ties."""
    d = table(spark, sf_dir, "documents").select("lang", F.when(F.col("n_chars") > 3000, "long").when(F.col("n_chars") > 800, "medium").otherwise("short").alias("label"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "label")
    k = d.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("n2", F.lead("n").over(w)).withColumn("r", F.row_number().over(w)).where("r = 1")
    return k.select("lang", F.when(F.col("n2").isNull() | (F.col("n") > F.col("n2")), F.col("label")).otherwise("mixed").alias("dominant"), "n")


@register("""WITH p AS (SELECT chat_id, seq, played, sum(ms) OVER (PARTITION BY chat_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - ms AS before, ms, text FROM (SELECT conv_id AS chat_id, turn AS seq, text, length(text) * 60 AS ms, 9000 AS played FROM conversations WHERE role = 'assistant'))
    SELECT chat_id, seq, CAST(floor(len(string_split(text, ' ')) * least(1.0, greatest(0, played - before) / nullif(ms, 0)::DOUBLE)) AS BIGINT) AS heard_words FROM p WHERE before < played""")
def sc34_heard_prefix(spark, sf_dir):
    """SC-34, ST-16: how many words of each spoken piece were heard in nine seconds of playing."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), "text", (F.length("text") * 60).alias("ms"))
    before = F.sum("ms").over(Window.partitionBy("chat_id").orderBy("seq").rowsBetween(*W.UP_TO_NOW)) - F.col("ms")
    share = F.least(F.lit(1.0), F.try_divide(F.greatest(F.lit(0), 9000 - F.col("before")).cast("double"), F.col("ms").cast("double")))
    return c.withColumn("before", before).where("before < 9000").select("chat_id", "seq", F.floor(F.size(F.split("text", " ")) * share).cast("long").alias("heard_words"))


def _ema(state, row):
    """WN-22: a level that rises by half and falls by 15 % of the difference."""
    if row is None:
        return state, []
    level = row.value if state is None else state + (0.5 if row.value > state else 0.15) * (row.value - state)
    return level, [(row.user_id, row.event_id, round(level, 6))]


@register("""WITH RECURSIVE e AS (SELECT user_id, event_id, value::DOUBLE AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
    r AS (SELECT user_id, event_id, i, value AS level FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, level + CASE WHEN value > level THEN 0.5::DOUBLE ELSE 0.15::DOUBLE END * (value - level) FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    SELECT user_id, event_id, round(level, 6) AS level FROM r""")
def wn22_user_level(spark, sf_dir):
    """WN-22."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", "ts", "event_id", "value")
    return W.folded(e, "user_id", ["ts", "event_id"], _ema, lambda: None, "user_id long, event_id long, level double")


def packer(limit: int):
    """WN-13: consecutive pieces share a chunk while their tokens fit."""

    def step(state, row):
        n, tokens = state
        if row is None:
            return state, []
        cost = -(-len(row.text) * 2 // 7)
        n, tokens = (n, tokens + cost) if tokens + cost <= limit and n else (n + 1, cost)
        return (n, tokens), [(row.chat_id, row.seq, n, tokens)]

    return step


@register(f"""WITH RECURSIVE {MESSAGES_SQL}, m AS (SELECT chat_id, seq, CAST(ceil(length(text) * 2 / 7) AS BIGINT) AS cost, row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS i FROM msgs),
    r AS (SELECT chat_id, seq, i, 1::BIGINT AS chunk, cost AS tokens FROM m WHERE i = 1 UNION ALL SELECT m.chat_id, m.seq, m.i, CASE WHEN tokens + cost <= 420 THEN chunk ELSE chunk + 1 END, CASE WHEN tokens + cost <= 420 THEN tokens + cost ELSE cost END FROM r JOIN m ON m.chat_id = r.chat_id AND m.i = r.i + 1)
    SELECT chat_id, seq, chunk, tokens FROM r""")
def wn13_chunk_pack(spark, sf_dir):
    """WN-13, SC-10: turns of a conversation merged into chunks of at most 420 tokens."""
    return W.folded(messages(spark, sf_dir), "chat_id", ["seq"], packer(420), lambda: (0, 0), "chat_id long, seq long, chunk long, tokens long")


def budget(limit: int, extra: int = 24):
    """WN-14: by rank, what fits stays; what doesn't is skipped, and a smaller one later may still fit; the first always stays."""

    def step(left, row):
        if row is None:
            return left, []
        cost = -(-row.n_chars * 2 // 7) + extra
        kept = left is None or cost <= left
        return ((limit if left is None else left) - cost if kept else left), [(row.source, row.doc_id, kept)]

    return step


@register("""WITH RECURSIVE d AS (SELECT source, doc_id, CAST(ceil(n_chars * 2 / 7) AS BIGINT) + 24 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    r AS (SELECT source, doc_id, i, true AS kept, 3000 - cost AS left_over FROM d WHERE i = 1 UNION ALL SELECT d.source, d.doc_id, d.i, cost <= left_over, left_over - CASE WHEN cost <= left_over THEN cost ELSE 0 END FROM r JOIN d ON d.source = r.source AND d.i = r.i + 1)
    SELECT source, doc_id, kept FROM r""")
def wn14_source_budget(spark, sf_dir):
    """WN-14: documents of a source by id, within 3000 tokens."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return W.folded(d, "source", ["doc_id"], budget(3000), lambda: None, "source string, doc_id long, kept boolean")
